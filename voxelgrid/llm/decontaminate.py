"""Benchmark decontamination by spaced seeds.

A mask covers a span of words and looks at some of them only, so that a substituted word at
an ignored place does not change its hash. Hashes of the benchmark under each mask are looked
up for all places of all texts; a hit fixes an alignment, along which matching words are
extended in both directions while they outweigh the substitutions.

Contracts
* null or empty texts and items have no overlap; neither have items of under ``least`` words.
* an item shorter than the longest mask must occur word for word.
* each disjoint overlap of a text with an item is reported; of those that share words the one
  with the most matches, at a tie the one found first.
* repeated items are reported under each of their ids; null ids stay null. Rows stand for
  themselves: repeated rows and ids give repeated results, empty tables none.
* the benchmark is handed to the tasks in parts of a bounded number of words; a larger
  benchmark takes more passes over the texts, one after the other, never a cut.
* all columns pass through; a column that has the output's name is replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._store import written
from ._worker import kept

_U = np.uint64
#: Places looked at. Every overlap of 12 to 20 words that is accepted below, wherever its
#: substitutions are, has a place where one of these masks looks at none of them (a test counts
#: them all); longer ones have many more places. The extension from there may still stop short
#: where substitutions lie close together.
MASKS = ("11101011", "1100100001011", "11010001011", "1111011", "1110010011", "101000011011", "111001010001")
SPAN = 13
LEAST_WORDS = 8
#: Matching words that make an overlap, and the share of matches in it.
LEAST_MATCHES = 12
SHARE = 0.75
#: A run of this much lost ground ends an extension.
DROP = 6
PART_WORDS = 2_000_000
BITS = 22

OVERLAP = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("matched", T.IntegerType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())]))


def _mask_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, len(mask), _U)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = _text.mix(out) + words[i : i + n]
    return _text.mix(out)


class Seeds:
    """The benchmark's words, and a sorted table of hashes under each mask."""

    def __init__(self, ids: list, words: np.ndarray, bounds: np.ndarray):
        self.ids, self.words, self.bounds = ids, words, bounds
        n = np.diff(bounds)
        item = np.repeat(np.arange(len(n)), n)
        self.item = item
        self.tables = []
        for mask in MASKS:
            h = _mask_hashes(words, mask)
            at = np.flatnonzero(item[: len(h)] == item[len(mask) - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
            self._add(mask, h[at], at)
        for length in sorted(set(n[(n >= LEAST_WORDS) & (n < SPAN)].tolist())):
            mask = "1" * length
            at = bounds[:-1][n == length]
            self._add(mask, _mask_hashes(words, mask)[at], at)

    def _add(self, mask: str, hashes: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        filter_ = np.zeros(1 << BITS, bool)
        filter_[(hashes >> _U(64 - BITS)).astype(np.int64)] = True
        self.tables.append((mask, hashes[order], at[order], filter_))

    def overlaps(self, words: np.ndarray, bounds: np.ndarray) -> list[list[tuple]]:
        """Per row: (item id, matches, first word, last word) of the disjoint overlaps with each item."""
        found: list[dict[int, list[tuple]]] = [{} for _ in range(len(bounds) - 1)]
        tried: dict[tuple[int, int, int], int] = {}
        for mask, keys, places, filter_ in self.tables:
            if not len(keys) or len(words) < len(mask):
                continue
            h = _mask_hashes(words, mask)
            likely = np.flatnonzero(filter_[(h >> _U(64 - BITS)).astype(np.int64)])
            first = np.searchsorted(keys, h[likely])
            hit = likely[keys[np.minimum(first, len(keys) - 1)] == h[likely]]
            for i in hit.tolist():
                row = int(np.searchsorted(bounds, i, "right")) - 1
                if i + len(mask) > bounds[row + 1]:
                    continue
                a, z = np.searchsorted(keys, h[i]), np.searchsorted(keys, h[i], "right")
                for place in places[a:z].tolist():
                    item = int(self.item[place])
                    key = (row, item, i - place)
                    # an accepted overlap is not extended again from hits within it; another hit may do better where one fails
                    if tried.get(key, -1) >= i:
                        continue
                    got, reached = self._extend(words, int(bounds[row]), int(bounds[row + 1]), i, place, item, len(mask))
                    if not got:
                        continue
                    tried[key] = max(reached, tried.get(key, -1))
                    one = found[row].setdefault(item, [])
                    shared = [x for x in one if got[1] <= x[2] and x[1] <= got[2]]
                    if all(got[0] > x[0] for x in shared):
                        one[:] = [*(x for x in one if x not in shared), got]
        return [[(self.ids[k], *v) for k, vs in sorted(one.items()) for v in sorted(vs, key=lambda x: x[1])] for one in found]

    def _extend(self, words, first, last, i, place, item, span):
        lo, hi = int(self.bounds[item]), int(self.bounds[item + 1])
        left, right = min(i - first, place - lo), min(last - i, hi - place)
        same = words[i - left : i + right] == self.words[place - left : place + right]
        gain = np.where(same, 1, -2)
        after = np.cumsum(gain[left + span :])
        before = np.cumsum(gain[:left][::-1])
        z = left + span + _reach(after)
        a = left - _reach(before)
        matches = int(same[a:z].sum())
        need = LEAST_MATCHES if hi - lo >= SPAN else hi - lo
        reached = i - left + z - 1
        if matches < need or matches < SHARE * (z - a):
            return None, reached
        return (matches, i - left + a - first, reached - first), reached


def _reach(sums: np.ndarray) -> int:
    """Length of the best prefix, before the first place that lies DROP below the best so far."""
    if not len(sums):
        return 0
    top = np.maximum.accumulate(np.maximum(sums, 0))
    lost = np.flatnonzero(top - sums >= DROP)
    sums = sums[: lost[0]] if len(lost) else sums
    if not len(sums) or sums.max() <= 0:
        return 0
    return int(np.argmax(sums)) + 1


def _parts(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark as (ids, words, bounds), some at a time; rows stream to the driver."""
    ids, texts, size = [], [], 0

    def packed():
        data, offsets = _text.arrow_bytes(pa.array(texts, pa.large_string()))
        return [ids.copy(), *_text.hash_words(data, offsets)]

    for row in benchmark.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "") // 2 + 1
        if size > PART_WORDS:
            yield packed()
            ids, texts, size = [], [], 0
    if ids:
        yield packed()


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "overlaps") -> DataFrame:
    """Adds an array of the overlaps with benchmark items, empty for clean documents."""
    schema = T.StructType([f for f in docs.schema if f.name != out] + [T.StructField(out, OVERLAP)])
    docs = docs.withColumn(out, F.array().cast(OVERLAP)).select(*[c for c in docs.columns if c != out], out)
    part = None
    for packed in _parts(benchmark, item_col, item_text_col):
        if part is not None:
            # one part's table at a time: the pass before ends, and its part goes
            before, docs = part, written(docs)
            before.unpersist()
        part = docs.sparkSession.sparkContext.broadcast(packed)

        def run(batches, part=part, key=("seeds", uuid.uuid4().hex)):
            seeds = kept(key, lambda: Seeds(*part.value))
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("matched", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
            for b in batches:
                data, offsets = _text.arrow_bytes(b.column(b.schema.get_field_index(text_col)))
                found = []
                for a, z in _text.slices(data, offsets):
                    found += seeds.overlaps(*_text.hash_words(data, offsets[a : z + 1]))
                earlier = b.column(b.schema.get_field_index(out)).to_pylist()
                every = [[tuple(x.values()) for x in e] + f for e, f in zip(earlier, found, strict=True)]
                values = pa.array([[dict(zip(("item_id", "matched", "first_word", "last_word"), x, strict=True)) for x in one] for one in every], kind)
                names = [n for n in b.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), values], names=[*names, out])

        docs = docs.mapInArrow(run, schema)
    return docs
