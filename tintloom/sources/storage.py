"""Files on any file system that pyarrow knows: streams, moves, and writing at a place where the system can."""

from __future__ import annotations

import os


def resolve(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def uri(path: str) -> str:
    """The path as Spark reads it: without a scheme it is a local one."""
    return path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))


def is_local(path: str) -> bool:
    return resolve(path)[0].type_name == "local"


def open_output(path: str):
    system, place = resolve(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(place)


def size_of(path: str) -> int | None:
    """Bytes of a file, or None if there is none."""
    system, place = resolve(path)
    info = system.get_file_info(place)
    return info.size if info.is_file else None


def remove(path: str) -> None:
    """A file or a folder with all in it, if it is there."""
    system, place = resolve(path)
    info = system.get_file_info(place)
    if info.is_file:
        system.delete_file(place)
    elif info.type.name == "Directory":
        system.delete_dir(place)


def move(source: str, target: str) -> None:
    """Rename within a file system. Where that was done before, by a task that ran twice, nothing is left to do."""
    system, place = resolve(source)
    there = resolve(target)[1]
    system.create_dir(there.rsplit("/", 1)[0], recursive=True)
    if system.get_file_info(there).type.name == "Directory":
        raise IsADirectoryError(f"a folder stands at {target}")
    if system.get_file_info(place).is_file or not system.get_file_info(there).is_file:
        system.move(place, there)


def write_at(path: str, pieces: list[tuple[int, bytes]]) -> None:
    """Write each (offset, bytes) into a local file that other tasks write too, making it if it isn't there."""
    place = resolve(path)[1]
    os.makedirs(os.path.dirname(place), exist_ok=True)
    f = os.open(place, os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        for offset, data in pieces:
            done = 0
            while done < len(data):
                done += os.pwrite(f, memoryview(data)[done:], offset + done)
    finally:
        os.close(f)
