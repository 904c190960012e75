"""Repeated passages that are many short lines, near copies, or in buckets of many members."""

import random

import numpy as np
import pyarrow as pa

from voxelgrid.llm import _text, passages


def distinct(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnop", k=8)) for _ in range(n)]


def lines(w, size):
    return "\n".join(" ".join(w[i : i + size]) for i in range(0, len(w), size))


def reported(spark, texts):
    """Documents with a passage, and the words removed of each."""
    got = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    out = {}
    for r in got:
        out[r.doc_id] = out.get(r.doc_id, 0) + (r.n_words if r.removed else 0)
    return out


def pairs_of(make, n=60):
    """Texts 2k and 2k + 1 hold the same passage between words of their own."""
    return [t for k in range(n) for t in make(k)]


def near(w, at):
    return [*w[:at], "changed" + w[at], *w[at + 1 :]]


def test_near_copies_of_paragraphs(spark):
    sizes = (40, 45, 50)

    def make(k):
        size = sizes[k % 3]
        p = distinct(size, k)
        # one changed word of 40 leaves a similarity of 31 / 41
        return [" ".join(distinct(30, f"{k}a")) + "\n" + " ".join(p), " ".join(distinct(33, f"{k}b")) + "\n" + " ".join(near(p, 5 + k % (size - 10)))]

    got = reported(spark, pairs_of(make, 150))
    assert sum(got.get(2 * k + 1, 0) >= sizes[k % 3] for k in range(150)) >= 145


def test_neighbours_do_not_cut():
    def digests(text):
        return set(passages.Units(*_text.arrow_bytes(pa.array([text])), 8).digest.tolist())

    line = " ".join(distinct(90, 1))
    assert len(digests(line)) > 3
    assert all(digests(line) <= digests(f"{' '.join(distinct(40, s))}\n{line}\n{' '.join(distinct(41, -s))}") for s in range(3, 20))


def test_passages_of_lines(spark):
    kinds = ((56, 7), (60, 12), (60, 15), (60, 20), (24, 3), (20, 10))

    def make(k):
        n, size = kinds[k % 6]
        return [f"{lines(distinct(25, f'{k}{x}'), 6)}\n{lines(distinct(n, k), size)}\n{lines(distinct(31, f'{k}{x}z'), 9)}" for x in "ab"]

    got = reported(spark, pairs_of(make, 120))
    assert all(got.get(2 * k + 1) == kinds[k % 6][0] and got.get(2 * k) == 0 for k in range(120))


def test_passages_inside_a_line(spark):
    def make(k):
        return [" ".join([*distinct(40, f"{k}{x}"), *distinct((35, 51, 60)[k % 3], k), *distinct(45, f"{k}{x}z")]) for x in "ab"]

    got = reported(spark, pairs_of(make, 150))
    assert sum(got.get(2 * k + 1, 0) >= 20 for k in range(150)) >= 148


def test_buckets_of_many_members(spark):
    common = distinct(24, 0)
    # two texts of a pair are alike to 0.92 or more, texts of different pairs to about 0.6
    texts = pairs_of(lambda k: [" ".join([*common, *distinct(6, k)]), " ".join([*common, *distinct(6, k), "more"])], 400)
    got = reported(spark, texts)
    assert sum(got.get(2 * k + 1, 0) > 30 for k in range(400)) >= 396


def test_cells_join_every_similar_pair(spark):
    r = np.random.default_rng(1)
    base = r.integers(1, 2**60, 18, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, extra, r.integers(1, 2**60, k % 2, dtype=np.uint64)])) for extra in r.integers(1, 2**60, (700, 5), dtype=np.uint64) for k in range(2)]
    size = [len(x) for x in sets]
    known = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "d long, s binary")
    # one band bucket of 1400 members: a class of 300, and the others alone
    members = spark.createDataFrame([(5, i) for i in range(len(sets))], "sig long, digest long")
    label = spark.createDataFrame([(i, 0) for i in range(300)], "node long, component long")
    got = {(min(x), max(x)) for x in passages._rest(members, label, known, 0.75).collect()}
    assert all(len(np.intersect1d(sets[a], sets[b])) >= 0.75 * (size[a] + size[b] - len(np.intersect1d(sets[a], sets[b]))) for a, b in got)
    assert {(2 * k, 2 * k + 1) for k in range(150, 700)} <= got


def test_no_word_leaves_every_copy(spark):
    """(A), (A B), (B): what goes from one text stays in another. Whole lines lose no word; inside
    of a long line a piece at the seam may be similar to another one, and go with words beside it."""
    r = random.Random(5)
    rows = []
    for k in range(12):
        a, b = distinct(r.randint(60, 100), f"A{k}"), distinct(r.randint(60, 100), f"B{k}")
        rows += [lines(a, 12), f"{lines(a, 12)}\n{lines(b, 12)}", lines(b, 12)] if k % 2 else [" ".join(a), " ".join([*a, *b]), " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = passages.repeated_passages(docs)
    left = {x.doc_id: (x.text or "").split() for x in passages.without_passages(docs, found).collect()}
    for k in range(12):
        every = set(rows[3 * k + 1].split())
        lost = every - {w for d in range(3 * k, 3 * k + 3) for w in left[d]}
        assert len(lost) <= (0 if k % 2 else 0.05 * len(every))
        # the second copies of A and of B go, but for a few words at the edges
        assert sum(len(left[d]) for d in range(3 * k, 3 * k + 3)) <= 1.25 * len(every)
