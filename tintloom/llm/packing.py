"""Packing documents into training sequences by minimum bin slack.

Each document's ids, with an end mark, are cut into full windows and one rest. The rests are packed by length:
a bitset subset-sum search over the multiset of remaining lengths finds the fill of a window that comes closest
to its capacity; the counts found by backtracking are applied as often as the lengths last. Only the counts
by length (one row a length, so at most `capacity` rows) reach the driver, whatever the size of the corpus;
the pieces get their places by their rank among the pieces of their length.

Null texts count as empty; an empty text still has its end mark, so one piece of length 1. Rows that repeat are
packed each on its own. A null doc_id stays null. An empty table gives an empty result. Only doc_id and text are read,
whatever other columns are named.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, materialize, small_batches, table, text_of, tidy

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Pieces of one length are ranked in groups of about so many.
RANKED = 1000
SLOTS = "length int, low long, high long, each long, first_sequence long, first_offset long"


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + length], one after the other."""
    out, at = np.empty(int(length.sum()), flat.dtype), 0
    for i in range(0, len(start), 1 << 16):  # indices of some stretches at a time
        a, n = start[i : i + (1 << 16)], length[i : i + (1 << 16)]
        ends = np.cumsum(n)
        total = int(ends[-1])
        np.take(flat, np.repeat(a - ends + n, n) + np.arange(total), out=out[at : at + total])
        at += total
    return out


def found_in(strings: pa.Array, held: pa.Array) -> np.ndarray:
    """The place in held, or -1, of each of some strings; both are distinct. Only strings, the fewer, are put into a table."""
    out = np.full(len(strings), -1)
    at = pc.index_in(held, value_set=strings)
    out[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return out


class Ids:
    """Distinct strings in the order in which they were met, and the ids of each."""

    def __init__(self):
        self.strings = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.start = self.length = np.zeros(0, np.int64)
        self.chars = 0

    def __iter__(self):
        return iter(self.strings.to_pylist())

    def add(self, strings: pa.Array, ids: np.ndarray, length: np.ndarray) -> None:
        self.chars += pc.sum(pc.utf8_length(strings)).as_py() or 0
        self.strings = pa.concat_arrays([self.strings, strings])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids])

    def places(self, strings: pa.Array, learn) -> np.ndarray:
        """The place here of each string. What isn't here yet is added: learn(new) gives an order to add them in, and
        their ids and numbers of ids in that order."""
        coded = strings.dictionary_encode()
        distinct = coded.dictionary
        place = found_in(distinct, self.strings)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            order, ids, length = learn(distinct.take(pa.array(missing)))
            place[missing[order]] = np.arange(len(missing)) + len(self.strings)
            self.add(distinct.take(pa.array(missing[order])), ids, length)
        return place[coded.indices.to_numpy()]

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at some places, one after the other, and how many each has."""
        length = self.length[places]
        return gather(self.ids, self.start[places], length), length


class Words:
    """Maps texts to their ids, by Arrow and NumPy over many texts at once.

    The tokenizer drops white space and no word crosses it, so stretches without white space are encoded one by one, each
    distinct one once. What was met is kept, stretches in two generations, bounded in entries and in characters, and
    forgotten when a task ends.
    """

    most = 500_000
    most_chars = 8_000_000
    #: So many new words are encoded by one call.
    at_once = 5_000
    #: Python and Arrow take these for white space, the tokenizer doesn't.
    odd = "[\x1c-\x1f]"
    #: Kinds of characters in the tokenizer's pattern: white space parts, numbers stand alone, runs of the others are words.
    SPACE, LETTER, NUMBER, OTHER = range(1, 5)

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # for words that are in normal form, parted and written in the characters that stand for bytes
        self.plainer = Tokenizer(self.tokenizer.model)
        self.plainer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: The character that stands for each byte; the space goes on to part words. Bytes that are in no UTF-8 have none.
        self.byte_chars = np.zeros(256, "<u4")
        for s in map(chr, [*range(0x80), *range(0x80, 0x800, 0x20), *range(0x80, 0xC0), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x400)]):
            self.byte_chars[list(s.encode())] = [ord(c) for c in level.pre_tokenize_str(s)[0][0]]
        self.byte_chars[0x20] = 0x20
        ids = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(ids.values()) + 1, bool)
        self.closes[[i for t, i in ids.items() if t.endswith("</w>")]] = True
        #: The kinds of the characters met, by code point; 0: not met yet.
        self.kind = np.zeros(0x110000, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known, self.older, self.pieces = Ids(), Ids(), self.no_pieces()

    def no_pieces(self) -> Ids:
        """No words yet; a space is none, it has no ids."""
        held = Ids()
        held.add(pa.array([" "]), held.ids, np.zeros(1, np.int64))
        return held

    def full(self, held: Ids) -> bool:
        return len(held.strings) > self.most or held.chars > self.most_chars

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain_of(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some strings, one after the other, and how many each has: by the tokenizer's own call for each."""
        each = [np.frombuffer(self.plain(s), "<u4") for s in strings.to_pylist()]
        return np.concatenate(each), np.array([len(x) for x in each])

    def kind_of(self, char: str) -> int:
        """The kind of a character, as the tokenizer itself parts it."""
        part = self.tokenizer.pre_tokenizer.pre_tokenize_str
        found = len(part(f"a{char}a"))  # 1: a letter, 2: dropped
        if found < 3:
            return self.LETTER if found == 1 else self.SPACE
        return self.OTHER if len(part(f"!{char}!")) == 1 else self.NUMBER

    def parts(self, text: str) -> np.ndarray:
        r"""Where words begin in a text of normal form, and its spaces: by the tokenizer's pattern
        's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.kind[points]
        if not kind.all():
            for p in np.unique(points[kind == 0]).tolist():
                self.kind[p] = self.kind_of(chr(p))
            kind = self.kind[points]
        begins = np.ones(len(kind), bool)
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= (kind == self.NUMBER) | (kind == self.SPACE)
        # an apostrophe that begins a word takes some letters after it along
        marks = np.flatnonzero((points == 0x27) & begins)
        after = np.concatenate([points, np.zeros(2, "<u4")])
        first, second = after[marks + 1], after[marks + 2]
        two = (first == ord("r")) & (second == ord("e")) | (first == ord("v")) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        one = np.isin(first, [ord(c) for c in "stmd"])
        begins[marks[one | two] + 1] = False
        nexts = np.concatenate([marks[one] + 2, marks[two] + 3])
        begins[nexts[nexts < len(kind)]] = True
        return np.flatnonzero(begins)

    def learn_pieces(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode new words, many by one call; the last token of each word tells where it ends."""
        ids, lengths = [], []
        for i in range(0, len(new), self.at_once):
            some = new.slice(i, self.at_once)
            text = self.byte_chars[np.frombuffer(joined(some).encode(), np.uint8)].tobytes().decode("utf-32-le")
            found = np.array(self.plainer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[found]) + 1
            if len(ends) == len(some):
                ids.append(found)
                lengths.append(np.diff(ends, prepend=0))
            else:
                for held, x in zip((ids, lengths), self.plain_of(some), strict=True):
                    held.append(x)
        return np.arange(len(new)), np.concatenate(ids), np.concatenate(lengths)

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode new stretches; what is in the older generation is taken from there."""
        at = found_in(new, self.older.strings)
        plain = pc.string_is_ascii(new).to_numpy(zero_copy_only=False)
        old, low, other = np.flatnonzero(at >= 0), np.flatnonzero((at < 0) & plain), np.flatnonzero((at < 0) & ~plain)
        ids, length = self.older.of(at[old])
        texts = [joined(new.take(pa.array(low))).lower()] if len(low) else []
        if len(other):
            texts.append(self.tokenizer.normalizer.normalize_str(joined(new.take(pa.array(other)))))
        if not texts:
            return old, ids, length
        fresh = np.concatenate([low, other])
        text = " ".join([*texts, ""])  # a space after each stretch
        new_ids, new_length = self.encode_normal(text) if text.count(" ") == len(fresh) else self.plain_of(new.take(pa.array(fresh)))
        return np.concatenate([old, fresh]), np.concatenate([ids, new_ids]), np.concatenate([length, new_length])

    def encode_normal(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches in normal form with a space after each, and how many each has."""
        data = text.encode()
        begins = self.parts(text)
        if len(data) > len(text):
            begins = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)[begins]
        offsets = np.append(begins, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data))
        if self.full(self.pieces):
            self.pieces = self.no_pieces()
        ids, length = self.pieces.of(self.pieces.places(pieces, self.learn_pieces))
        ends = np.cumsum(length)[np.frombuffer(data, np.uint8)[begins] == 0x20]
        return ids, np.diff(ends, prepend=0)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after the other, and where each text's begin, with the end of the last."""
        odd = pc.match_substring_regex(texts, self.odd)
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        # Arrow may leave white space in what it splits off the end of a text
        parted = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.if_else(odd, "", texts) if len(odd_at) else texts))
        offsets = parted.offsets.to_numpy()
        if self.full(self.known):
            self.older, self.known = self.known, Ids()
        ids, length = self.known.of(self.known.places(parted.values.slice(offsets[0], offsets[-1] - offsets[0]), self.learn))
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])[offsets - offsets[0]]
        if len(odd_at):
            each = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            for i in odd_at.tolist():
                each[i] = np.frombuffer(self.plain(texts[i].as_py()), "<u4")
            ids, bounds = np.concatenate(each), np.cumsum([0, *map(len, each)])
        return ids, bounds

    def encode_all(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def joined(strings: pa.Array) -> str:
    """Strings, parted by spaces."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(strings)], strings), " ")[0].as_py()


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def encode_pieces(docs: DataFrame, capacity: int, path: str | None = None) -> DataFrame:
    """Rows (doc_id, doc_tokens, crcs array<long>, salt): a document's length and the crc32 of each window."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "salt", "doc_tokens", "crcs"]

    def run(batches):
        if path is None:
            import public_tokenizers

            code = words(public_tokenizers.path(VOCABULARY))
        else:
            code = words(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids, bounds = code.encode_array(batch.column(2))
            data, crcs = memoryview(ids.astype("<u4", copy=False)).cast("B"), []
            for a, b in zip((bounds[:-1] * 4).tolist(), (bounds[1:] * 4).tolist(), strict=True):
                own = [zlib.crc32(data[i : min(i + 4 * capacity, b)]) for i in range(a, b, 4 * capacity)]
                if (b - a) % (4 * capacity):  # the end mark goes into the last window
                    own[-1] = zlib.crc32(end, own[-1])
                else:
                    own.append(zlib.crc32(end))
                crcs.append(own)
            lengths = pa.array(np.diff(bounds) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lengths, pa.array(crcs, pa.list_(pa.int64()))], names=names)
        code.forget()  # the worker goes on with other tasks

    rows = docs.select(id_of().alias("doc_id"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), text_of().alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, salt long, doc_tokens long, crcs array<long>")


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most counts of each, whose sum comes closest to room from below."""
    reach, steps, full = 1, [], (1 << room + 1) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        times = 1
        while left and not reach >> room & 1:
            times = min(times, left)
            steps.append((length, times, reach))
            reach = (reach | reach << length * times) & full
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            used[length] = used.get(length, 0) + times
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for counts[length] pieces of each length: rows (length, low, high, each, first_sequence, first_offset).

    Pieces of rank low to high - 1 go to sequences first_sequence, +1, ..., `each` a sequence, side by side.
    """
    left, given, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        seed = max(left)
        rest = {k: n - (k == seed) for k, n in left.items() if n > (k == seed)}
        used = best_fill(rest, capacity - seed)
        used[seed] = used.get(seed, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for k in sorted(used, reverse=True):
            n = used[k]
            rows.append((k, given[k], given[k] + n * times, n, sequence, offset))
            offset += n * k
            given[k] += n * times
            left[k] -= n * times
            if not left[k]:
                del left[k]
        sequence += times
    return rows


def pack(docs: DataFrame, *, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece and its place."""
    spark = docs.sparkSession
    coded = materialize(encode_pieces(docs, capacity, path), "coded")
    pieces = coded.select("doc_id", "doc_tokens", "salt", F.posexplode("crcs").alias("at", "ids_crc32")).select(
        "doc_id",
        (F.col("at").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("doc_tokens") - F.col("at") * capacity).cast("int").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.xxhash64("salt", "at").alias("mark"),
    )
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(plan(counts, capacity), SLOTS)
    parts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in counts.items()], "length int, parts int")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod("mark", "parts")).drop("parts")
    sizes = dealt.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("length", "part").orderBy("mark", "doc_id", "start"))
    ranked = dealt.withColumn("inner", inner).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("inner") - 1)
    at = F.col("rank") - F.col("low")
    # slots has a few rows for each of at most `capacity` lengths
    return ranked.join(F.broadcast(slots), "length").where("rank >= low and rank < high").select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(at / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + at % F.col("each") * F.col("length")).alias("offset"),
    )


def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
