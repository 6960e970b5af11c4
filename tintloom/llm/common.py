"""Helpers that the operators share: tables, written intermediates, components, word hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing document id where a key must not be null.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By application, where the session names no folder.
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the context has as checkpoint folder.

    A local master may do without (tests): then it is a temporary folder. On a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.sparkContext.applicationId
        if own not in _folders:
            _folders[own] = "file://" + tempfile.mkdtemp(prefix="tintloom-")
        found = _folders[own]
    return found.rstrip("/")


#: Tables written within ``scratch``, by its depth.
_written: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Deletes at its end what ``materialize`` wrote within, but for the tables given to the function it yields."""
    own: list[DataFrame] = []
    _written.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x is not df]
        return df

    try:
        yield keep
    finally:
        _written.pop()
        for df in own:
            discard(df)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    Spark removes the files when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_at = path
    if _written:
        _written[-1].append(written)
    return written


def discard(written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    if _written and any(df is written for df in _written[-1]):
        _written[-1][:] = [df for df in _written[-1] if df is not written]
    jvm, spark = written.sparkSession._jvm, written.sparkSession
    place = jvm.org.apache.hadoop.fs.Path(written.written_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int = 20_000, most_bytes: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch, since one text can be very long, and its rows."""
    for key, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", most_bytes)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) != str(value):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


#: Bits of a filter that tells which hashes are wanted; its size doesn't depend on the corpus.
FILTER_BITS = 1 << 26


def wanted_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of a long column modulo FILTER_BITS. What it lets through by chance is to be joined away."""
    place = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(place, 6).cast("int").alias("word"), F.shiftleft(F.lit(1).cast("long"), 0).alias("one"), place.bitwiseAND(63).cast("int").alias("at"))
    words = words.select("word", F.expr("shiftleft(one, at)").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for part in words.toArrow().to_batches():  # FILTER_BITS / 64 rows at most
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out.view(np.uint64)


def wanted(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned values may be wanted."""
    place = values % np.uint64(FILTER_BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def text_where(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (doc_id, text) of the documents whose id is among ids (doc_id): few others are moved."""
    spark = docs.sparkSession
    small_batches(spark)
    bits = spark.sparkContext.broadcast(wanted_filter(ids, "doc_id"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted(bits.value, batch.column(0).to_numpy().view(np.uint64))))

    rows = docs.select(F.coalesce(id_of(), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string").join(ids, "doc_id", "left_semi")


def tidy(run):
    """run, a function over Arrow batches, giving memory that it no longer needs back to the system when it ends.

    A worker outlives its tasks, and allocators keep what they have freed.
    """

    def go(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return go


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_of(column: str = "doc_id") -> Column:
    return F.col(column).cast("long")


#: At most so many keys are taken as frequent.
FREQUENT_KEYS = 5_000


def join_by_key(left: DataFrame, right: DataFrame, keys: list[str], times: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key (no nulls) and tells in ``times`` how many rows of left have it.

    Keys with more than one in FREQUENT_KEYS of all these rows (fewer than FREQUENT_KEYS, whatever the tables) are
    broadcast, so that no task gets all rows of a frequent key; the others are joined as usual. Both tables are read
    twice, so they should be written ones. how: inner or left.
    """
    total = right.agg(F.sum(times)).first()[0] or 0
    often = F.col(times) > max(1, total // FREQUENT_KEYS)
    hot, rest = right.where(often), right.where(~often)
    near = left.join(F.broadcast(hot), keys)
    far = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return near.unionByName(far)


#: So many edges or fewer are joined by one task: each step over them would have more tasks than rows are worth.
FEW_EDGES = 200_000


def smallest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node of each one's component. Roots with a smaller neighbour are hung on it
    until each edge is within one tree."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _components_of_few(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]  # FEW_EDGES at most
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in smallest_of(*np.concatenate(held, 1))], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(tidy(run), "node long, component long")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component being the smallest node.

    Alternates large-star and small-star steps until the set of edges stands still. Each step is one
    aggregation with partial sums and one join, so a hub is never gathered into one group. FEW_EDGES or fewer take none.
    Nodes without an edge to another node don't appear.
    """
    apart = materialize(edges.where("a <> b").select("a", "b"), "edges")
    if apart.count() <= FEW_EDGES:
        return _components_of_few(apart)
    now = materialize(apart.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    discard(apart)
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialize(small.unionByName(root.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: the steps of splitmix64."""
    x = x + _MULT
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64. What was needed is kept, up to a bound."""

    base = np.uint64(0x5851F42D4C957F2D)
    inverse = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)
    most_kept = 1 << 21

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) >= n:
            return cls.up[:n], cls.down[:n]
        grown = np.full(n, cls.base), np.full(n, cls.inverse)
        for x in grown:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        if n <= cls.most_kept:
            cls.up, cls.down = grown
        return grown


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Long texts are cut at blanks into parts of so many characters, and bytes are hashed by windows of so many.
PART = 400_000
_blank = re.compile("[ \n]").search


def parts_of(texts: list[str], most: int = PART, cut=_blank):
    """Texts in order, short ones together and each long one by parts that begin at a blank: yields the index of the
    first text and the texts or the part. A stretch without blanks isn't cut."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > most:
            yield first, held
            held, size = [], 0
        if len(t) <= most:
            first = i if not held else first
            held.append(t)
            size += len(t)
            continue
        begin = 0
        while begin < len(t):
            found = cut(t, begin + most)
            end = found.start() if found else len(t)
            yield i, [t[begin:end]]
            begin = end
    if held:
        yield first, held


def _byte_word_hashes(raw: bytes, window: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of each word of lower-cased UTF-8. A word that goes over windows is summed up piece by piece."""
    data = np.frombuffer(raw, np.uint8)
    starts, values = [], []
    going = 0  # bytes so far of a word that goes on into this window
    for a in range(0, len(data), window):
        piece = data[a : a + window]
        inside = _WORD[piece]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, stop = edge[::2], edge[1::2]
        up, down = Powers.get(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        value = (total[stop] - total[start]) * down[start]
        if going and len(start) and start[0] == 0:
            values[-1][-1:] += value[:1] * np.uint64(pow(int(Powers.base), going, 2**64))
            going += int(stop[0])
            over = len(start) == 1 and stop[0] == len(piece)
            start, stop, value = start[1:], stop[1:], value[1:]
            if over:
                continue
        going = int(stop[-1] - start[-1]) if len(stop) and stop[-1] == len(piece) else 0
        if len(start):
            starts.append(start + a)
            values.append(value)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), mix(np.concatenate(values))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of lower-cased texts, in order: the index of the text, and a 64-bit hash.

    Words are runs of letters, digits and characters beyond ASCII; all else parts them. Beside the result, arrays of
    one part of a text are held at a time, however long the text.
    """
    of, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for first, held in parts_of(texts):
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in held]
        start, value = _byte_word_hashes(b"\n".join([*raw, b""]))
        of.append(first + np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right"))
        hashes.append(value)
    return np.concatenate(of), np.concatenate(hashes)


def shingle_hashes(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of `width` words of each text: index of the text, and hash. A text of fewer words, but at
    least one, has one shingle of all its words; a text without words has none."""
    of, words = word_hashes(texts)
    n = len(words)
    factor = [np.uint64(pow(0xD1342543DE82EF95, k, 2**64)) for k in range(width)]
    if n >= width:
        value = sum((words[k : n - width + 1 + k] * factor[k] for k in range(1, width)), words[: n - width + 1] * factor[0])
        whole = of[: n - width + 1] == of[width - 1 :]
        which, value = of[: n - width + 1][whole], value[whole]
    else:
        which, value = of[:0], words[:0]
    counts = np.bincount(of, minlength=len(texts))
    if len(short := np.flatnonzero((counts > 0) & (counts < width))):
        first = np.searchsorted(of, short)
        more = [(words[i : i + c] * np.array(factor[:c])).sum() for i, c in zip(first, counts[short].tolist(), strict=True)]
        which = np.concatenate([which, short])
        value = np.concatenate([value, np.array(more, np.uint64)])
        order = np.argsort(which, kind="stable")
        which, value = which[order], value[order]
    return which, mix(value)


def slices(texts: list[str], most: int = 2_000_000, most_texts: int = 1_000):
    """Index ranges of texts of about `most` characters, so that working arrays stay small."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and (held + len(t) > most or i - begin >= most_texts):
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)
