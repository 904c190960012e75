"""Spaced seeds against all substitutions of short overlaps, second copies, and parts of a benchmark."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrid.llm import decontaminate


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijkl", k=7)) for _ in range(n)]


@pytest.mark.parametrize("n", range(12, 21))
def test_every_accepted_overlap_has_a_seed(n):
    most = min(n - decontaminate.LEAST_MATCHES, int(n * (1 - decontaminate.SHARE)))
    bad = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(1, n - 1), most)], np.int64)
    seen = np.zeros(len(bad), bool)
    for mask in decontaminate.MASKS:
        m = sum(1 << i for i, c in enumerate(mask) if c == "1")
        for at in range(n - len(mask) + 1):
            seen |= (bad & (m << at)) == 0
    assert seen.all()


def test_substitutions_copies_and_parts(spark, monkeypatch):
    items = [words(24, k) for k in range(6)]
    bench = spark.createDataFrame([*((k, " ".join(w)) for k, w in enumerate(items)), (None, " ".join(items[0]))], "item_id long, text string")
    rows, want = [], {}
    for k, w in enumerate(items):
        changed = list(w)
        for i in (3, 8, 13, 18):
            changed[i] = f"new{i}"
        rows.append((k, " ".join([*words(9, 100 + k), *changed, *words(5, 200 + k), *w, *words(4, 300 + k)])))
        want[k] = {(9, 20), (38, 24)}
    rows += [(50, None), (51, ""), (52, " ".join(words(400, 999))), (52, " ".join(words(400, 999)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    for part_words in (2_000_000, 20):
        monkeypatch.setattr(decontaminate, "PART_WORDS", part_words)
        found = decontaminate.find_overlaps(docs, bench).collect()
        got = {}
        for r in found:
            got.setdefault(r.doc_id, set()).update((o.item_id, o.first_word, o.matched) for o in r.overlaps)
        for k in range(6):
            ids = {k, None} if k == 0 else {k}
            assert got[k] == {(i, *x) for i in ids for x in want[k]}, part_words
        assert len(found) == 10 and not got[50] | got[51] | got[52]
    assert decontaminate.find_overlaps(docs.where("false"), bench).count() == 0
    assert all(not r.overlaps for r in decontaminate.find_overlaps(docs, bench.where("false")).collect())
