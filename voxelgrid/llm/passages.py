"""Repeated passages by MinHash banding of paragraphs.

A paragraph is a line. One of over LONG_WORDS words is taken as a whole and in pieces: it is
cut where the hash of a word is the least of its neighbourhood within the line, so that a
passage is cut alike wherever it stands. A paragraph's word shingles
give MinHash bands, tuned for a recall at the similarity threshold. Distinct paragraphs that
collide in a band are verified by exact Jaccard; classes of similar paragraphs are
components, of which the first occurrence stays (and what overlaps it in its document).

Word for word, windows of ``least_words`` words are compared as well, across line ends: those
that begin or end where a line does or at a content-defined place. So short lines and pieces
join with their neighbours, and no stretch of whole lines is too finely divided to be found.

Contracts
* null or empty text has no paragraphs; paragraphs of under ``least_words`` words (5 at least) take part in windows only.
* repeated stretches of under ``least_passage`` words in a row are left alone.
* occurrences are ordered by id, then place; repeated ids are numbered anew (``_store.identified``).
* extra columns of the input are ignored; an empty table gives no rows. Repeated rows are
  repeats of each other: all but the first go.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._components import components
from ._store import drop, identified, tasks_for, written

_U = np.uint64
SHINGLE = 5
REACH = 7
#: Lines of more words are compared in pieces too.
LONG_WORDS = 30
#: Words to both sides of a place where windows begin and end.
WINDOW_REACH = 4
LEAST_WORDS = 8
LEAST_PASSAGE = 20
ROWS_PER_BAND = 2
RECALL = 0.99
#: Bits of the fixed-size filter of paragraphs that collide in some band.
FILTER_BITS = 24
SALTS = 16
ENTRIES_PER_TASK = 4_000_000
#: Members of a band bucket that are compared with each other in one cell.
CELL = 256
#: Columns of a cell's incidence matrix at a time.
BLOCK = 4096


def bands(threshold: float, recall: float = RECALL, rows: int = ROWS_PER_BAND) -> int:
    """Fewest bands that find a pair at the threshold with at least this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _windows(words: np.ndarray) -> np.ndarray:
    """Hashes of all windows of SHINGLE words."""
    n = max(0, len(words) - SHINGLE + 1)
    h = words[:n].copy()
    for k in range(1, SHINGLE):
        h = _text.mix(h) + words[k : n + k]
    return _text.mix(h)


def _least_around(h: np.ndarray, line: np.ndarray, reach: int) -> np.ndarray:
    """Which words have a smaller hash than all others of their line within this reach."""
    low = np.ones(len(h), bool)
    for k in range(1, min(reach, len(h) - 1) + 1):
        apart = line[:-k] != line[k:]
        low[:-k] &= (h[:-k] < h[k:]) | apart
        low[k:] &= (h[k:] < h[:-k]) | apart
    return low


class Units:
    """The paragraphs and pieces of a slice of texts: their row, first word, words, and shingle hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int, windows: bool = False):
        newline = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0] + 1
        lines = np.union1d(offsets, newline)
        words, bounds = _text.hash_words(data, lines)
        n = len(words)
        first_word = bounds[np.searchsorted(lines, offsets)]
        lengths = np.diff(bounds)
        begin, lengths = bounds[:-1][lengths > 0], lengths[lengths > 0]
        line = np.repeat(np.arange(len(begin)), lengths)
        long = lengths > LONG_WORDS
        start = np.zeros(n, bool)
        start[begin] = True
        h = _text.mix(words + _U(11))
        start |= _least_around(h, line, REACH) & long[line]
        if windows:
            self._windows(words, first_word, begin, np.flatnonzero(_least_around(h, line, WINDOW_REACH)), max(least, SHINGLE))
        at = np.flatnonzero(start)
        size = np.diff(np.concatenate([at, [n]]))
        whole = long & (np.bincount(line[at], minlength=len(begin)) > 1)
        at, size = np.concatenate([at, begin[whole]]), np.concatenate([size, lengths[whole]])
        keep = size >= max(least, SHINGLE)
        self.at, self.size = at[keep], size[keep]
        self.row = np.searchsorted(first_word, self.at, "right") - 1
        self.first = self.at - first_word[self.row]
        count = self.size - SHINGLE + 1
        self.starts = np.cumsum(count) - count
        unit = np.repeat(np.arange(len(count)), count)
        self.hashes = _windows(words)[np.arange(len(unit)) + np.repeat(self.at - self.starts, count)]
        # a set's identity: the sum over its distinct hashes
        mixed = _text.mix(self.hashes)
        own = mixed ^ _text.mix(unit.astype(_U) + _U(1))
        order = np.argsort(own)
        again = order[1:][own[order[1:]] == own[order[:-1]]]
        mixed[again] = 0
        self.digest = np.add.reduceat(mixed, self.starts) if len(count) else np.zeros(0, _U)
        self.distinct = count - np.bincount(unit[again], minlength=len(count))

    def _windows(self, words, first_word, begin, places, size) -> None:
        """Row, first word and digest of the windows; longer gaps between places are filled with windows."""
        begins = np.union1d(begin, places)
        last = first_word[np.minimum(np.searchsorted(first_word, begins, "right"), len(first_word) - 1)]
        room = np.minimum(np.append(begins[1:], len(words)), last) - begins
        more = np.where(room > 2 * size, room // size, 0)
        filled = np.repeat(begins, more) + size * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1)
        ends = np.union1d(begins, first_word)
        at = np.unique(np.concatenate([begins, filled, ends[ends >= size] - size]))
        row = np.searchsorted(first_word, at, "right") - 1
        inside = at + size <= first_word[np.minimum(row + 1, len(first_word) - 1)]
        at, self.window_row = at[inside], row[inside]
        self.window_first = at - first_word[self.window_row]
        h = np.full(len(at), size, _U)
        for k in range(size):
            h = _text.mix(h) + words[at + k]
        self.window_digest = _text.mix(h)

    def set_of(self, i: int) -> np.ndarray:
        """The distinct shingle hashes of a paragraph, sorted."""
        return np.unique(self.hashes[self.starts[i] : self.starts[i] + self.size[i] - SHINGLE + 1])

    def minhashes(self, k: int, some: np.ndarray) -> np.ndarray:
        """``k`` MinHash values of each of the paragraphs ``some``."""
        count = self.size[some] - SHINGLE + 1
        starts = np.cumsum(count) - count
        hashes = self.hashes[np.arange(int(count.sum())) + np.repeat(self.starts[some] - starts, count)]
        hashes ^= hashes >> _U(29)
        odd = _text.mix(np.arange(1, k + 1, dtype=_U)) | _U(1)
        out = np.zeros((k, len(some)), _U)
        for j in range(k if len(some) else 0):
            # the hashes are mixed already: an odd factor orders them anew
            out[j] = np.minimum.reduceat(hashes * odd[j], starts)
        return out


def _units(batch: pa.RecordBatch, least: int, windows: bool = False):
    data, offsets = _text.arrow_bytes(batch.column(1))
    for a, z in _text.slices(data, offsets):
        u = Units(data, offsets[a : z + 1], least, windows)
        if len(u.digest) or windows and len(u.window_digest):
            yield a, u


def _dealt(key: np.ndarray, n: int):
    """(part, places) of each part of a hash range that has any."""
    part = (((key >> _U(40)) * _U(n)) >> _U(24)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), order[cuts[p] : cuts[p + 1]]


def _candidates(docs: DataFrame, parts: int, threshold: float, least: int) -> DataFrame:
    """(sig, a, b) digests of distinct paragraphs that share a band: with the group's least, and with the next.

    A bucket of up to three has all its pairs among them; the members of larger ones are given
    too, as rows (sig, digest, null).
    """
    b_ = bands(threshold)

    def bands_of(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, u in _units(batch, least):
                digest, first = np.unique(u.digest, return_index=True)
                new = np.array([d not in seen for d in digest.tolist()], bool)
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.update(digest[new].tolist())
                first = first[new]
                if not len(first):
                    continue
                m = u.minhashes(b_ * ROWS_PER_BAND, first)
                sig = np.concatenate([_text.mix(np.add.reduce([_text.mix(m[j * ROWS_PER_BAND + r] + _U(r)) for r in range(ROWS_PER_BAND)]) + _U(j)) for j in range(b_)])
                own = np.tile(u.digest[first], b_)
                size = np.tile(u.distinct[first].astype(np.uint32), b_)
                rows = [(p, sig[i].tobytes(), own[i].tobytes(), size[i].tobytes()) for p, i in _dealt(sig, parts)]
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(x, pa.binary()) for x in c[1:])], names=["part", "sigs", "digests", "sizes"])

    def pair(batches):
        sig, digest, size = [], [], []
        for b in batches:
            for out, k, kind in ((sig, 1, _U), (digest, 2, _U), (size, 3, np.uint32)):
                out += [np.frombuffer(x, kind) for x in b.column(k).to_pylist()]
        if not sig:
            return
        sig, digest, size = np.concatenate(sig), np.concatenate(digest), np.concatenate(size)
        # sets of too unequal sizes are not similar: where a bucket's sizes leap, no pair crosses
        order = np.lexsort((size, sig))
        sig, digest, size = sig[order], digest[order], size[order]
        leap = np.append(True, (sig[1:] != sig[:-1]) | (size[:-1] < threshold * size[1:] - 1e-9))
        sig = _text.mix(sig + np.maximum.accumulate(np.where(leap, np.arange(len(sig)), 0)).astype(_U))
        order = np.lexsort((digest, sig))
        sig, digest = sig[order], digest[order]
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (digest[1:] != digest[:-1])])
        sig, digest = sig[fresh], digest[fresh]
        same = np.flatnonzero(sig[1:] == sig[:-1]) + 1
        lead = digest[np.searchsorted(sig, sig[same])]
        a, b = np.concatenate([lead, digest[same - 1]]), np.concatenate([digest[same], digest[same]])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), _U)
        _, back, n = np.unique(sig, return_inverse=True, return_counts=True)
        large = n[back] > 3
        none = np.zeros(pairs.shape[1], bool)
        columns = [np.concatenate([np.zeros(pairs.shape[1], _U), sig[large]]), np.concatenate([pairs[0], digest[large]]), np.concatenate([pairs[1], digest[large]])]
        member = np.concatenate([none, np.ones(int(large.sum()), bool)])
        arrays = [pa.array(columns[0].view(np.int64)), pa.array(columns[1].view(np.int64)), pa.array(columns[2].view(np.int64), mask=member)]
        yield from pa.table(arrays, names=["sig", "a", "b"]).to_batches(max_chunksize=100_000)

    rows = docs.select("node", "text").mapInArrow(bands_of, "part int, sigs binary, digests binary, sizes binary")
    return rows.repartitionById(parts, F.col("part")).mapInArrow(pair, "sig long, a long, b long")


def _filter(digests: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that has a bit for each digest."""
    place = F.shiftrightunsigned("d", 64 - FILTER_BITS)
    words = digests.select(F.shiftrightunsigned(place, 5).alias("w"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(d, {64 - FILTER_BITS}) & 31))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[words.column("w").to_numpy()] = words.column("m").to_numpy().astype(np.uint32)
    return bits


def _in_filter(bits: np.ndarray, digest: np.ndarray) -> np.ndarray:
    place = (digest >> _U(64 - FILTER_BITS)).astype(np.int64)
    return (bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1


def _sets(docs: DataFrame, bits, least: int) -> DataFrame:
    """(d, s): the shingle set of each paragraph that collides in some band."""

    def sets(batches):
        for batch in batches:
            for _, u in _units(batch, least):
                likely = np.flatnonzero(_in_filter(bits.value, u.digest))
                _, first = np.unique(u.digest[likely], return_index=True)
                some = likely[first]
                yield pa.RecordBatch.from_arrays([pa.array(u.digest[some].view(np.int64)), pa.array([u.set_of(i).tobytes() for i in some], pa.binary())], names=["d", "s"])

    # the first set of a digest is as good as any: equal digests have equal sets
    return docs.select("node", "text").mapInArrow(sets, "d long, s binary").groupBy("d").agg(F.min("s").alias("s"))


def _verified(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    def similar(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(known.select(F.col("d").alias("a"), F.col("s").alias("sa")), "a").join(known.select(F.col("d").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(similar, "a long, b long")


def _joined(digest: np.ndarray, label: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes of a cell that hold a similar pair; a joined pair is given once."""
    size = np.array([len(x) for x in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = often[column] > 1
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, BLOCK):
        some = (column >= at) & (column < at + BLOCK)
        here = np.zeros((len(sets), BLOCK), np.float32)
        here[row[some], column[some] - at] = 1
        both += here @ here.T
    _, up = np.unique(label, return_inverse=True)
    x, y = np.nonzero(np.triu(both >= threshold * (size[:, None] + size - both) - 1e-9, 1) & (up[:, None] != up))
    links, up = [], up.copy()
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        if up[i] != up[j]:
            up[up == up[j]] = up[i]
            links.append((int(digest[i]), int(digest[j])))
    return links


def _rest(members: DataFrame, label: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of buckets that their stars left in several classes, every pair across classes compared.

    A bucket's largest class is its main one; its other members are compared with it and with
    each other, in cells of bounded size. So a large class costs rows in proportion.
    """
    members = members.join(label.select(F.col("node").alias("digest"), "component"), "digest", "left")
    members = written(members.select("sig", "digest", F.coalesce("component", "digest").alias("c")))
    size = members.groupBy("sig", "c").count()
    size = size.groupBy("sig").agg(F.max(F.struct("count", "c")).alias("main"), F.sum("count").alias("n"), F.count("*").alias("classes")).where("classes > 1")
    size = size.select("sig", F.col("main.c").alias("main"), F.ceil(F.col("main.count") / CELL).alias("mains"), F.ceil((F.col("n") - F.col("main.count")) / CELL).alias("rests"), F.col("n") <= CELL)
    size = size.toDF("sig", "main", "mains", "rests", "small")
    dealt = members.join(size, "sig")
    h = F.xxhash64("digest")
    of_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda r: F.struct(r.alias("x"), F.lit(True).alias("m"), F.pmod(h, F.col("mains")).alias("y")))
    own = F.pmod(h, F.col("rests"))
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("mains") - 1), lambda m: F.struct(own.alias("x"), F.lit(True).alias("m"), m.alias("y")))
    with_rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda r: F.struct(F.least(own, r).alias("x"), F.lit(False).alias("m"), F.greatest(own, r).alias("y")))
    zero = F.lit(0).cast("long")
    cells = F.when(F.col("small"), F.array(F.struct(zero.alias("x"), F.lit(True).alias("m"), zero.alias("y")))).when(F.col("c") == F.col("main"), of_main).otherwise(F.concat(with_main, with_rest))
    dealt = dealt.select("digest", "c", "sig", F.explode(cells).alias("cell")).select("digest", "c", F.xxhash64("sig", "cell.x", "cell.m", "cell.y").alias("cell"))
    rows = dealt.join(known.select(F.col("d").alias("digest"), "s"), "digest").repartition(tasks_for(members.sparkSession), "cell").sortWithinPartitions("cell")

    def compared(batches):
        def links(group):
            d, c, x = zip(*group, strict=True)
            return _joined(np.array(d, np.int64), np.array(c, np.int64), [np.frombuffer(s, _U) for s in x], threshold) if len(set(c)) > 1 else []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        last, group = None, []
        for b in batches:
            found = []
            for d, c, cell, x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if cell != last and group:
                    found += links(group)
                    group = []
                last = cell
                group.append((d, c, x))
            yield out(found)
        if group:
            yield out(links(group))

    return rows.select("digest", "c", "cell", "s").mapInArrow(compared, "a long, b long")


def _occurrences(docs: DataFrame, parts: int, bits, least: int) -> DataFrame:
    """(d, node, first_word, n_words, later) of paragraphs that occur twice or may be similar to another, and of windows that occur twice.

    ``later`` is null for paragraphs; for windows it is false for the first and what overlaps it.
    """
    width = max(least, SHINGLE)

    def places(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for a, u in _units(batch, least, True):
                for digest, row, first, size in ((u.digest, u.row, u.first, u.size), (u.window_digest, u.window_row, u.window_first, 0)):
                    if not len(digest):
                        continue
                    # no words: a window
                    packed = np.zeros((len(digest), 3), np.int64)
                    packed[:, 0] = nodes[a + row]
                    packed[:, 1], packed[:, 2] = first, size
                    rows = [(p, digest[i].tobytes(), packed[i, 0].tobytes(), packed[i, 1:].astype(np.uint32).tobytes()) for p, i in _dealt(digest, parts)]
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(x, pa.binary()) for x in c[1:])], names=["part", "d", "node", "place"])

    def repeated(batches):
        d, node, place = [], [], []
        for b in batches:
            for out, k, kind in ((d, 1, _U), (node, 2, np.int64), (place, 3, np.uint32)):
                out += [np.frombuffer(x, kind) for x in b.column(k).to_pylist()]
        if not d:
            return
        d, node, place = np.concatenate(d), np.concatenate(node), np.concatenate(place).reshape(-1, 2)
        names = ["d", "node", "first_word", "n_words", "later"]
        window = place[:, 1] == 0
        dp, np_, pp = d[~window], node[~window], place[~window]
        _, back, n = np.unique(dp, return_inverse=True, return_counts=True)
        keep = (n[back] > 1) | _in_filter(bits.value, dp)
        yield from pa.table([dp[keep].view(np.int64), np_[keep], pp[keep, 0].astype(np.int64), pp[keep, 1].astype(np.int64), pa.nulls(int(keep.sum()), pa.bool_())], names=names).to_batches(max_chunksize=100_000)
        d, node, first = d[window], node[window], place[window, 0].astype(np.int64)
        if not len(d):
            return
        order = np.argsort(d)
        same = d[order[1:]] == d[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)]
        order = order[np.lexsort((first[order], node[order], d[order]))]
        d, node, first = d[order], node[order], first[order]
        lead = np.flatnonzero(np.append(True, d[1:] != d[:-1])[: len(d)])
        times = np.diff(np.append(lead, len(d)))
        later = (node != np.repeat(node[lead], times)) | (first >= np.repeat(first[lead], times) + width)
        keep = np.repeat(later[lead + times - 1], times)
        yield from pa.table([d[keep].view(np.int64), node[keep], first[keep], np.full(int(keep.sum()), width, np.int64), later[keep]], names=names).to_batches(max_chunksize=100_000)

    rows = docs.select("node", "text").mapInArrow(places, "part int, d binary, node binary, place binary")
    # a frequent paragraph's occurrences are counted here once per slice, packed in one row
    return rows.repartitionById(parts, F.col("part")).mapInArrow(repeated, "d long, node long, first_word long, n_words long, later boolean")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, least_words: int = LEAST_WORDS, least_passage: int = LEAST_PASSAGE) -> DataFrame:
    """One row per repeated passage of a document: id, first word, number of words, component, removed.

    ``component`` is the smallest class of its paragraphs and windows. Later occurrences join
    into passages that are ``removed``, first ones into passages that stay, so that of two
    repeats side by side only the later one goes. Every word that goes stands in an earlier place.
    """
    spark = docs.sparkSession
    docs, _ = identified(docs, id_col, text_col)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(tasks_for(spark), math.ceil(size / 90 * bands(threshold) / ENTRIES_PER_TASK))
    collided = written(_candidates(docs, parts, threshold, least_words))
    pairs, members = collided.where("b is not null").select("a", "b").distinct(), collided.where("b is null").select("sig", F.col("a").alias("digest"))
    bits = spark.sparkContext.broadcast(_filter(pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct()))
    known = written(_sets(docs, bits, least_words))
    links = written(_verified(pairs, known, threshold))
    label = written(components(links))
    more = written(_rest(members, label, known, threshold))
    if not more.isEmpty():
        drop(label)
        label = written(components(links.unionByName(more)))
    drop(collided, known, links, more)
    label = label.select(F.col("node").alias("ld"), F.col("component").alias("lc"))
    every = written(_occurrences(docs, parts, bits, least_words))
    places = every.where("later is null").drop("later")
    label = label.select("ld", "lc", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    dealt = places.withColumn("s", salt)
    classed = dealt.join(label, (F.col("d") == F.col("ld")) & (F.col("s") == F.col("part")), "left")
    classed = written(classed.select(F.coalesce("lc", "d").alias("component"), "node", "first_word", "n_words"))
    # a class that only overlaps itself, as a paragraph and its piece may, is no repeat
    firsts = classed.groupBy("component").agg(F.min(F.struct("node", "first_word", (-F.col("n_words")).alias("size"))).alias("lead"), F.max(F.struct("node", "first_word")).alias("last"))
    firsts = firsts.where("last.node > lead.node or last.first_word >= lead.first_word - lead.size")
    firsts = firsts.select(F.col("component").alias("fc"), "lead", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    again = classed.withColumn("s", salt).join(firsts, (F.col("component") == F.col("fc")) & (F.col("s") == F.col("part")))
    again = again.withColumn("later", F.expr("node <> lead.node or first_word >= lead.first_word - lead.size"))
    again = again.select("component", "node", "first_word", "n_words", "later").unionByName(every.where("later is not null").withColumnRenamed("d", "component"))
    # neighbouring and overlapping paragraphs join into one passage; a window holds one document's paragraphs
    place = Window.partitionBy("node", "later").orderBy("first_word")
    end = F.col("first_word") + F.col("n_words")
    gap = F.when(F.col("first_word") <= F.max(end).over(place.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    runs = again.withColumn("gap", gap).withColumn("run", F.sum("gap").over(place))
    found = runs.groupBy("node", F.col("later").alias("removed"), "run").agg(F.min("first_word").alias("first_word"), (F.max(end) - F.min("first_word")).alias("n_words"), F.min("component").alias("component"))
    found = found.where(F.col("n_words") >= least_passage).drop("run")
    named = docs.select("node", F.col("id").alias(id_col))
    return found.join(named, "node").select(id_col, "node", "first_word", "n_words", "component", "removed")


def without_passages(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (of unique ids) with the words of removed passages cut out of the texts; all columns pass through."""
    import re

    key, spans = (next(f"{name}{k}" for k in range(len(docs.columns) + 1) if f"{name}{k}" not in docs.columns) for name in ("id_", "spans_"))
    cut = passages.where("removed").groupBy(F.col(id_col).alias(key)).agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias(spans))
    schema = docs.schema
    rows = docs.join(cut, docs[id_col] == cut[key], "left").drop(key)

    def run(batches):
        word = re.compile(rb"[^\x20\x09-\x0D]+")
        for b in batches:
            texts = []
            for text, cuts in zip(b.column(b.schema.get_field_index(text_col)).to_pylist(), b.column(b.schema.get_field_index(spans)).to_pylist(), strict=True):
                if text and cuts:
                    raw = text.encode()
                    at = [m.span() for m in word.finditer(raw)]
                    kept, last = [], 0
                    for c in cuts:
                        kept.append(raw[last : at[c["first_word"]][0]])
                        last = at[c["first_word"] + c["n_words"] - 1][1]
                    text = b"".join([*kept, raw[last:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text_col else b.column(b.schema.get_field_index(n)) for n in schema.names], names=schema.names)

    return rows.mapInArrow(run, schema)
