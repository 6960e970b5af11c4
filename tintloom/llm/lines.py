"""Line dedup by a segment-partition edit join.

A document's lines are parted by line feeds and trimmed. Lines within ``edits`` edits of each other are linked, and
connected lines form a class; of each class the occurrence with the smallest (doc_id, hash of the text, line number) stays.

Candidates: a line of length l is cut into edits + 1 even segments, of which a line within reach must hold one
unchanged. So segments are indexed by length, ordinal and hash, and a line probes with those of its substrings whose
place can match: of lengths l down to l - edits, shifted by no more than the edits before and behind allow. Bit
vectors of the parities of hashed character pairs (an edit changes 4 at most) and of hashed characters (2) screen
candidates before banded bit-parallel edit distance decides. A very frequent segment, found on a sample of lines, is
split: two screened lines that share it agree in one of 4 * edits + 1 parts of their bit vectors, which then are part
of the key. The sample only chooses the way; both ways are exact. Within a segment, lines are first compared with one
line; then only with those of other components. Lines are known by 64-bit hashes.

Lines shorter than ``least_near`` characters are compared exactly, those shorter than ``least`` not at all and stay.
Nulls count as empty texts; a text without lines to drop stays as it is; a document whose lines are all dropped goes.
A row is known by its doc_id and a 64-bit hash of its text: rows with one doc_id or none are documents of their own,
in the order of their hashes, and null ids come first; only rows that repeat with id and text (or with no id and the
same text) count as one document, and each keeps the lines that it keeps. Texts of any length are taken whole, a part
at a time; only a single line is never cut, and takes some 45 bytes a character. An empty table gives an empty result. Only doc_id and text are read; ``dedup`` passes all other columns on, whatever
their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Powers, components, id_of, join_by_key, materialize, mix, parts_of, small_batches, table, text_of, tidy, wanted, wanted_filter

#: A key that occurs so often in the sample of lines (one in SAMPLE) is split; at most so many keys are.
SAMPLE, FREQUENT, MOST_SPLIT = 64, 4, 50_000
#: Texts are worked on by slices of so many characters.
PIECE = 400_000
_K1, _K2, _K3 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


class Lines:
    """The lines of some texts: index of the text, number in the text, begin and end among the code points."""

    def __init__(self, texts: list[str], least: int):
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        breaks = np.flatnonzero(codes == 10)
        begin, end = np.concatenate([[0], breaks[:-1] + 1]), breaks.copy()
        lengths = np.array([t.count("\n") + 1 for t in texts])
        self.of = np.repeat(np.arange(len(texts)), lengths)
        self.number = np.arange(len(begin)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        # the first and last characters of each line that aren't blank; a line of blanks is empty, at its end
        full = np.flatnonzero(~blank)
        begin = np.minimum(np.append(full, len(codes))[np.searchsorted(full, begin)], end)
        end = np.maximum(np.append(full, -1)[np.searchsorted(full, end) - 1] + 1, begin)
        self.codes, self.begin, self.end = codes, begin, end
        self.size = end - begin
        self.chosen = np.flatnonzero(self.size >= least)
        up, self.down = Powers.get(len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.total[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * _K1)

    def _parities(self, classes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        bit = np.zeros(len(self.codes) + 1, np.uint64)
        np.left_shift(np.uint64(1), classes, out=bit[1 : len(classes) + 1])
        np.bitwise_xor.accumulate(bit, out=bit)
        return bit[end] ^ bit[begin]

    def parities(self, which: np.ndarray) -> np.ndarray:
        """64 parities of the hashed character pairs of each line."""
        c = self.codes.astype(np.uint64)
        begin = self.begin[which]
        return self._parities((c[:-1] * _K2 + c[1:] * _K3) >> np.uint64(58), begin, np.maximum(self.end[which] - 1, begin))

    def letters(self, which: np.ndarray) -> np.ndarray:
        """64 parities of the hashed characters of each line."""
        return self._parities(self.codes.astype(np.uint64) * _K1 >> np.uint64(58), self.begin[which], self.end[which])


_feed = re.compile("\n").search


def lines_of(texts: list[str], least: int):
    """Lines of some texts at a time, with the text and the number therein of each line. Long texts are cut at line feeds,
    so that working arrays stay small; only a single line is never cut."""
    last, passed = -1, 0
    for first, held in parts_of(texts, PIECE, _feed):
        on = first == last and len(held) == 1  # a further part of the text before: it begins with the feed that parts them
        lines = Lines([held[0][1:]] if on else held, least)
        if not on:
            passed = 0
        yield lines, first + lines.of, passed + lines.number
        last, passed = first, passed + len(lines.begin)


def _segments(size: np.ndarray, ordinal: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of a segment within a line of that size."""
    base, rest = size // (edits + 1), size % (edits + 1)
    short = edits + 1 - rest
    return ordinal * base + np.maximum(0, ordinal - short), base + (ordinal >= short)


def _key(lines: Lines, begin: np.ndarray, length: np.ndarray, size: np.ndarray, ordinal: int) -> np.ndarray:
    return mix(lines.hashes(begin, begin + length) + size.astype(np.uint64) * _K2 + mix(np.array([ordinal], np.uint64)))


def index_keys(lines: Lines, which: np.ndarray, edits: int) -> np.ndarray:
    size = lines.size[which]
    out = []
    for i in range(edits + 1):
        at, length = _segments(size, i, edits)
        out.append(_key(lines, lines.begin[which] + at, length, size, i))
    return np.stack(out, 1)


def probe_keys(lines: Lines, which: np.ndarray, edits: int):
    """For each substring that may match an indexed segment: the lines, the key, and how much longer the line is.

    A line's own segments are left out: they are indexed, and an indexed line also probes.
    """
    size, begin = lines.size[which], lines.begin[which]
    for less in range(edits + 1):
        short = size - less
        for i in range(edits + 1):
            at, length = _segments(short, i, edits)
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                if not less and not shift:
                    continue
                fits = (at + shift >= 0) & (at + shift + length <= size) & (short > edits)
                yield which[fits], _key(lines, (begin + at + shift)[fits], length[fits], short[fits], i), less


def _split(keys: np.ndarray, parities: np.ndarray, parts: int) -> list[np.ndarray]:
    """The keys of a split segment, one for each part of the bit vector."""
    bounds = [64 * k // parts for k in range(parts + 1)]
    return [mix(keys * _K1 + (parities >> np.uint64(a) & np.uint64((1 << b - a) - 1)) * _K2 + np.uint64(k)) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def edit_distances(pairs: list[tuple[str, str]], most: int) -> np.ndarray:
    """Edit distances of many pairs side by side by the bits of a diagonal band; ``most`` + 1 where it is more.

    Bit 63 stands for the lowest diagonal of the band; lengths differ by ``most`` at the most and exceed it.
    """
    n = len(pairs)
    longer = [np.frombuffer(max(p, key=len).encode("utf-32-le", "surrogatepass"), "<u4") for p in pairs]
    shorter = [np.frombuffer(min(p[::-1], key=len).encode("utf-32-le", "surrogatepass"), "<u4") for p in pairs]
    m, k = np.array([len(x) for x in longer]), np.array([len(x) for x in shorter])
    wide = int(m.max())
    pattern = np.full((n, wide + 2 * most + 1), 0xFFFFFFFF, np.uint32)
    text = np.full((n, wide), 0xFFFFFFFE, np.uint32)
    for r, (a, b) in enumerate(zip(longer, shorter, strict=True)):
        pattern[r, most : most + len(a)] = a
        text[r, : len(b)] = b
    match = np.zeros((n, wide), np.uint64)
    for d in range(2 * most + 1):
        match |= (pattern[:, d : d + wide] == text).astype(np.uint64) << np.uint64(63 - 2 * most + d)
    one = np.uint64(1)
    plus = np.full(n, (0xFFFFFFFFFFFFFFFF << (63 - most)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    minus = np.zeros(n, np.uint64)
    distance = np.full(n, most)
    across = np.full(n, 1 << 62, np.uint64)
    for i in range(int(k.max())):
        x = match[:, i]
        diagonal = (((x & plus) + plus) ^ plus) | x | minus
        up, down = minus | ~(diagonal | plus), diagonal & plus
        first, live = i < m - most, i < k
        step = np.where(first, (diagonal >> np.uint64(63) == 0).astype(int), ((up & across) != 0).astype(int) - ((down & across) != 0).astype(int))
        distance += np.where(live, step, 0)
        across = np.where(first, across, across >> one)
        plus, minus = down | ~((diagonal >> one) | up), (diagonal >> one) & up
        if i % 64 == 63 and (distance > 3 * most).all():
            break
    return np.minimum(distance, most + 1)


def occurrences(docs: DataFrame, least: int, least_near: int, edits: int) -> DataFrame:
    """Rows (doc_id, tag, lines array<struct<number, h, parities, letters>>, sample array<long>); tag is the text's hash."""
    kind = pa.struct([("number", pa.int32()), ("h", pa.int64()), ("parities", pa.int64()), ("letters", pa.int64())])

    def run(batches):
        for batch in batches:
            owners, held, sampled, keys = [], [], [], [np.zeros(0, np.uint64)]
            for lines, of, number in lines_of(batch.column(1).to_pylist(), least):
                w = lines.chosen
                h = lines.hashes(lines.begin[w], lines.end[w])
                owners.append(of[w])
                held.append([number[w].astype(np.int32), *(x.view(np.int64) for x in (h, lines.parities(w), lines.letters(w)))])
                some = (lines.size[w] >= least_near) & (h % np.uint64(SAMPLE) == 0)
                sampled.append(of[w[some]])
                keys.append(index_keys(lines, w[some], edits).ravel())
            if not held:
                continue
            rows = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], fields=list(kind))
            places = np.arange(batch.num_rows + 1)
            ends = np.searchsorted(np.concatenate(owners), places).astype(np.int32)
            at = np.searchsorted(np.concatenate(sampled), places).astype(np.int32) * (edits + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(ends, rows), pa.ListArray.from_arrays(at, pa.array(np.concatenate(keys).view(np.int64)))], names=["doc_id", "tag", "lines", "sample"])

    rows = docs.select(F.coalesce(id_of(), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("tag"))
    return rows.mapInArrow(tidy(run), "doc_id long, tag long, lines array<struct<number: int, h: long, parities: long, letters: long>>, sample array<long>")


def keyed(docs: DataFrame, frequent: np.ndarray, least_near: int, edits: int) -> DataFrame:
    """Rows (key, h, kind): kind is -1 for a line's own segment, else how much longer the probing line is."""
    parts = 4 * edits + 1

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            for lines, _, _ in lines_of(batch.column(0).to_pylist(), least_near):
                w = lines.chosen
                all_h = lines.hashes(lines.begin, lines.end)
                # lines that this task has met already needn't be sent again
                first = np.unique(all_h[w], return_index=True)[1]
                w = w[first]
                new = np.array([h not in known for h in all_h[w].tolist()], bool)
                w = w[new]
                if len(known) < 100_000:
                    known.update(all_h[w].tolist())
                parities = None
                index = index_keys(lines, w, edits)
                groups = [(w, index[:, i], -1) for i in range(edits + 1)] + list(probe_keys(lines, w, edits))
                for which, keys, kind in groups:
                    at = np.searchsorted(frequent, keys)
                    hot = frequent[np.minimum(at, len(frequent) - 1)] == keys if len(frequent) else np.zeros(len(keys), bool)
                    out_k, out_h = [keys[~hot]], [all_h[which[~hot]]]
                    if hot.any():
                        if parities is None:
                            parities = np.zeros(len(all_h), np.uint64)
                            parities[w] = lines.parities(w)
                        for sub in _split(keys[hot], parities[which[hot]], parts):
                            out_k.append(sub)
                            out_h.append(all_h[which[hot]])
                    k, h = np.concatenate(out_k), np.concatenate(out_h)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(h.view(np.int64)), pa.array(np.full(len(k), kind, np.int8))], names=["key", "h", "kind"])

    return docs.select(text_of().alias("text")).mapInArrow(tidy(run), "key long, h long, kind byte")


def shared(rows: DataFrame) -> DataFrame:
    """The distinct rows of keys that several lines have. A stream over rows sorted by key; holds one batch."""

    def run(batches):
        held = None
        for batch in batches:
            k, h, kind = (batch.column(i).to_numpy() for i in range(3))
            if held is not None:
                k, h, kind = (np.concatenate([x, y]) for x, y in zip(held, (k, h, kind), strict=True))
            if not len(k):
                continue
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])])
            k, h, kind = k[new], h[new], kind[new]
            # the last line of the last key waits for what follows, together with one row that tells of a line before it
            group = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            ends = np.append(group[1:], len(k))
            several = h[group] != h[ends - 1]
            if len(group) > 1:
                cut = group[-1]
                use = np.repeat(several[:-1], np.diff(group))
                yield _frame(k[:cut][use], h[:cut][use], kind[:cut][use])
                held = k[cut:], h[cut:], kind[cut:]
            elif several[0]:
                # one key that fills the batch: hand on all but its last line
                cut = int(np.searchsorted(h, h[-1]))
                yield _frame(k[:cut], h[:cut], kind[:cut])
                # the kept part still counts as several: mark it by keeping one earlier row, dropped as a repeat later
                held = k[cut - 1 :], h[cut - 1 :], kind[cut - 1 :]
            else:
                held = k, h, kind
        if held is not None and len(held[0]) and held[1][0] != held[1][-1]:
            yield _frame(*held)

    def _frame(k, h, kind):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(h), pa.array(kind)], names=["key", "h", "kind"])

    ordered = rows.repartition("key").sortWithinPartitions("key", "h", "kind")
    return ordered.mapInArrow(run, "key long, h long, kind byte")


def line_texts(docs: DataFrame, ids: DataFrame, least_near: int) -> DataFrame:
    """Rows (h, line) of the lines whose hash is among ids (h). A written table."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted_filter(ids, "h"))

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            for lines, _, _ in lines_of(batch.column(0).to_pylist(), least_near):
                w = lines.chosen
                h = lines.hashes(lines.begin[w], lines.end[w])
                some = np.flatnonzero(wanted(bits.value, h))
                if len(known) > 100_000:
                    known.clear()
                out_h, out = [], []
                raw = lines.codes.tobytes()
                for j in some.tolist():
                    v = int(h[j])
                    if v not in known:
                        known.add(v)
                        out_h.append(v)
                        out.append(raw[4 * lines.begin[w[j]] : 4 * lines.end[w[j]]].decode("utf-32-le", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(out_h, np.uint64).view(np.int64)), pa.array(out, pa.string())], names=["h", "line"])

    found = docs.select(text_of().alias("text")).mapInArrow(tidy(run), "h long, line string")
    out = materialize(found.join(ids, "h", "left_semi").dropDuplicates(["h"]), "lines")
    bits.destroy()
    return out


def verify(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) that are at most ``edits`` edits apart."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lines = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            good = np.zeros(len(lines), bool)
            order = [i for i in sorted(range(len(lines)), key=lambda i: len(lines[i][0])) if abs(len(lines[i][0]) - len(lines[i][1])) <= edits]
            begin = 0
            while begin < len(order):
                # pairs of about the same length side by side, in a bounded number of cells
                size = max(map(len, lines[order[begin]]))
                end = begin + 1
                while end < len(order) and end - begin < 4096 and max(map(len, lines[order[end]])) <= size * 1.2 + 8 and (end - begin) * size < 2_000_000:
                    end += 1
                now = order[begin:end]
                good[now] = edit_distances([lines[i] for i in now], edits) <= edits
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def line_classes(docs: DataFrame, occ: DataFrame, least_near: int, edits: int) -> DataFrame | None:
    """Rows (node, component) of the linked lines, by hash; None if there are none."""
    sample = occ.select(F.explode("sample").alias("key")).groupBy("key").count().where(F.col("count") >= FREQUENT)
    frequent = np.sort(np.array([r[0] for r in sample.orderBy(F.desc("count"), "key").limit(MOST_SPLIT).collect()], np.int64).view(np.uint64))
    rows = materialize(shared(keyed(docs, frequent, least_near, edits)), "shared")
    if rows.isEmpty():
        return None
    ids = rows.select("h").distinct()
    lines = occ.select(F.explode("lines").alias("l")).select("l.h", "l.parities", "l.letters").dropDuplicates(["h"]).join(ids, "h", "left_semi")
    rows = materialize(rows.join(lines, "h"), "screened")
    texts = line_texts(docs, ids, least_near)
    apart = lambda c: F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    near = (apart("parities") <= 4 * edits) & (apart("letters") <= 2 * edits)
    links, found, done = None, None, None
    for step in range(2):
        if found is None:
            part = rows.withColumn("component", F.col("h"))
        else:
            part = rows.join(found, rows.h == found.node, "left").select(*rows.columns, F.coalesce("component", "h").alias("component"))
            mixed = part.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
            part = materialize(part.join(mixed, "key", "left_semi"), "mixed")
        index, probe = part.where("kind = -1"), part
        if step == 0:
            index = index.groupBy("key").agg(F.min(F.struct("h", "parities", "letters", "component")).alias("lead")).select("key", "lead.*")
        # lines of equal length meet both ways round: one is enough once all are compared
        order = F.col("x.h") != F.col("y.h") if step == 0 else (F.col("y.kind") >= 0) | (F.col("x.h") < F.col("y.h"))
        pairs = index.alias("x").join(probe.alias("y"), F.col("x.key") == F.col("y.key")).where(near & order & (F.col("x.component") != F.col("y.component")))
        pairs = pairs.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            continue
        good = materialize(verify(pairs, texts, edits), "links")
        done = pairs if done is None else done.unionByName(pairs)
        links = good if links is None else links.unionByName(good)
        if not good.isEmpty():
            found = materialize(components(links), "components")
    return found


def drops(docs: DataFrame, *, edits: int = 2, least: int = 10, least_near: int = 32) -> DataFrame:
    """Rows (doc_id, tag, drop array<struct<number, h>>): the lines of each document that go; documents without any are left out."""
    small_batches(docs.sparkSession)
    occ = materialize(occurrences(docs, least, max(least_near, 4 * (edits + 1)), edits), "occurrences")
    found = line_classes(docs, occ, max(least_near, 4 * (edits + 1)), edits)
    rows = occ.select("doc_id", "tag", F.explode("lines").alias("l")).select("doc_id", "tag", "l.number", "l.h")
    # lines are gathered by hash, then classes, each with how often and where first it occurs
    each = rows.groupBy("h").agg(F.min(F.struct("doc_id", "tag", "number")).alias("first"), F.count("*").alias("times"))
    if found is None:
        each = each.where("times > 1").select("h", "times", "first")
    else:
        each = materialize(each.join(found.withColumnRenamed("node", "h"), "h", "left").withColumn("class", F.coalesce("component", "h")), "each")
        whole = each.groupBy("class").agg(F.min("first").alias("first"), F.sum("times").alias("n"), F.count("*").alias("lines")).where("n > 1").select("class", "first", "lines")
        each = join_by_key(each.select("h", "times", "class"), materialize(whole, "whole"), ["class"], "lines").select("h", "times", "first")
    gone = join_by_key(rows, materialize(each, "repeated"), ["h"], "times").where("not (doc_id = first.doc_id and tag = first.tag and number = first.number)")
    # rows that repeat with id and text are one document
    return gone.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("number", "h")).alias("drop"))


def _with_drops(docs: DataFrame, gone: DataFrame, columns: list[Column], schema: str) -> DataFrame:
    """Rows of the given columns of docs with kept (string), n_lines and n_dropped. Each text is sent once."""
    own = docs.select(*columns, F.coalesce(id_of(), F.lit(NO_ID)).alias("__id"), text_of().alias("__text"), F.xxhash64(text_of()).alias("__tag"))
    joined = own.join(gone.toDF("__id", "__tag", "drop"), ["__id", "__tag"], "left").drop("__id", "__tag").withColumn("numbers", F.col("drop.number")).withColumn("hs", F.col("drop.h")).drop("drop")
    n = len(columns)

    def run(batches):
        for batch in batches:
            texts, numbers, hs = (batch.column(i).to_pylist() for i in (n, n + 1, n + 2))
            kept, dropped = list(texts), np.zeros(len(texts), np.int32)
            some = [i for i, x in enumerate(numbers) if x]
            owners, hashed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lines, of, _ in lines_of([texts[i] for i in some], 0):
                owners.append(of)
                hashed.append(lines.hashes(lines.begin, lines.end).view(np.int64))
            h = np.concatenate(hashed)
            ends = np.searchsorted(np.concatenate(owners), np.arange(len(some) + 1))
            for j, i in enumerate(some):
                gone_ = set(zip(numbers[i], hs[i], strict=True))
                mine = h[ends[j] : ends[j + 1]].tolist()
                stay = [t for k, (t, v) in enumerate(zip(texts[i].split("\n"), mine, strict=True)) if (k, v) not in gone_]
                dropped[i] = len(mine) - len(stay)
                kept[i] = "\n".join(stay)
            count = pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(kept, pa.string()), count, pa.array(dropped)], names=[*batch.schema.names[:n], "kept", "n_lines", "n_dropped"])

    return joined.mapInArrow(tidy(run), schema + ", kept string, n_lines int, n_dropped int")


def apply_drops(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (doc_id, kept string, n_lines, n_dropped), one for each row of docs."""
    return _with_drops(docs, gone, [id_of().alias("doc_id")], "doc_id long")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with their lines deduplicated (and n_chars, if there, counted anew); documents left without a line go."""
    types = dict(docs.dtypes)
    # all columns but the text travel beside it
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    fields = "".join(f"`{c}`: {t}, " for c, t in docs.dtypes if c != "text")
    out = _with_drops(docs, drops(docs, **options), [F.struct(*others, F.col("text").isNull().alias("__none")).alias("row")], f"row struct<{fields}`__none`: boolean>")
    changed = F.col("n_dropped") > 0
    blank = F.length(F.regexp_replace("kept", r"\s+", "")) == 0
    new = {"text": F.when(~F.col("row.__none"), F.col("kept")).cast(types["text"])}
    if "n_chars" in types:
        new["n_chars"] = F.when(changed, F.length("kept").cast(types["n_chars"])).otherwise(F.col("row.n_chars"))
    return out.where(~(blank & changed)).select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_drops(docs, drops(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("kept").cast("long").alias("kept_chars"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


__all__ = ["dedup", "drops", "edit_distances", "op2_line_dedup"]
