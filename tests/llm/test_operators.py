"""Operators against brute force, on small tables with nulls, empty and repeated rows."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelgrid.llm import _text, bpe, decontaminate, language, line_dedup, ngram_join, ngram_lm, passages, quotes, token_files, topk

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = words(60, 1)
    rows = [(0, None, None), (1, "", "en"), (2, "  \n", "en"), (3, "One two", "en"), (4, "one TWO", "en"), (5, " ".join(base), "en")]
    for k in range(6, 30):
        w = list(base)
        r = random.Random(k)
        for _ in range(k % 5):
            w[r.randrange(60)] = "zz" + str(k)
        rows.append((k, " ".join(w[: 60 - k % 3]), "en"))
    rows += [(k, " ".join(words(40, k)), "de") for k in range(30, 40)]
    rows.append((40, "x " * 3000, "de"))
    return spark.createDataFrame(rows, SCHEMA)


def sets_of(docs):
    out = {}
    for r in docs.collect():
        w = (r.text or "").lower().split()
        out[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def test_similar_documents(docs):
    s = sets_of(docs)
    up = {d: d for d in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()}
    assert got == {d: (len(s[d]), find(d)) for d in s}


def test_similar_documents_of_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(rows).collect())
    assert got == Counter([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2)])
    assert ngram_join.similar_documents(rows.where("false")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_bpe_equals_library(spark, docs, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(name))
    odd = ["<|endoftext|>a<|endoftext|>", "don't  stop\n\n now", "naïve £5 ½ ١٢ 漢字かな 한글 🎉👩‍👩‍👧", "՘x\U0003fc3d1", "a" * 3000, "é    x\x1cy"]
    model = bpe.load(P.path(name))
    for t in odd:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(model.encode(t), "<u4").tolist() == ids, t
        assert model.decode(model.encode(t)) == library.decode(ids, skip_special_tokens=False)
    back = bpe.decode(bpe.encode(docs, P.path(name)), P.path(name)).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_token_files_equal_library(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(50, "<|startoftext|> Don't <|STARTOFTEXT|>\tx", None), (51, "É漢字 é!!!", None)], SCHEMA)
    rows = docs.unionByName(extra)
    folder = token_files.token_folder(rows)
    shards = token_files.write_tokens(rows, path, folder, end_id=1, shards=3, sequence=16)
    got = {r.id: (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_files.read_tokens(shards, folder).collect()}
    at = 0
    for r in sorted(rows.collect()):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    tokens, mask = token_files.Shard(folder, 0).sequences(0)
    assert len(tokens) == 16 and mask.all()


def test_token_files_of_hot_and_null_ids(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [" ".join(words(1 + k % 7, k)) for k in range(240)]
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(240)]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumns({"h": F.lit("clash"), "shard": F.lit("clash")})
    folder = token_files.token_folder(rows)
    shards = token_files.write_tokens(rows, path, folder, end_id=1, shards=9, sequence=16)
    sizes = [r.n_docs for r in shards.collect()]
    assert sum(sizes) == 240 and len(sizes) >= 8 and max(sizes) < 80
    got = sorted(token_files.read_tokens(shards, folder).collect(), key=lambda r: r.start)
    keys = [-1 if r.id is None else r.id for r in got]
    assert keys == sorted(keys)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    want = Counter((i, np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in zip(ids, texts, strict=True))
    assert Counter((r.id, bytes(r.ids)) for r in got) == want
    empty = token_files.write_tokens(rows.where("false"), path, folder + "-empty", end_id=1)
    assert token_files.read_tokens(empty, folder + "-empty").count() == 0


def test_language(spark, docs):
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[0].score == 0
    assert got[5].lang_pred == "en" and 0 <= got[5].score <= 1
    none = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_elias_fano():
    v = np.sort(np.random.default_rng(1).integers(0, 2**60, 3000).astype(np.uint64))
    for v in (v, v[:1], v[:0], np.repeat(v[:9], 100), np.arange(200, dtype=np.uint64)):
        e = ngram_lm.EliasFano.build(v)
        assert (e.get(np.arange(len(v))) == v).all() if len(v) else not e.n
        x = np.concatenate([v, v + np.uint64(1), [np.uint64(0), np.uint64(2**63)]])
        assert (e.successor(x) == np.searchsorted(v, x)).all()


@pytest.mark.parametrize(("least", "pairs"), [(ngram_lm.FREQUENT, ngram_lm.MOST_PAIRS), (ngram_lm.FREQUENT, 1), (20, 1), (20, 64)])
def test_language_model(docs, least, pairs):
    rows = docs.withColumn("train", F.col("doc_id") % 3 != 0)
    got = {r.id: r for r in ngram_lm.score_documents(rows, train="train", frequent_from=least, most_pairs=pairs).collect()}
    toks = {r.doc_id: [*(r.text or "").lower().split(), None] for r in docs.collect()}
    train = {d for d in toks if d % 3}
    c = Counter(t for d in train for t in toks[d])
    seen = Counter(p for d in train for p in zip([0, *toks[d]], toks[d], strict=False))
    n, v, m = sum(c.values()), len(c), ngram_lm.PRIOR
    for d, t in toks.items():
        r = got[d]
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)
        full = sum(np.log10((seen[u, w] + m * (c[w] + 1) / (n + v + 1)) / ((c[u] if u != 0 else len(train)) + m)) for u, w in zip([0, *t], t, strict=False))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(full, rel=1e-3)


def test_top_k(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 6))
    x[50:90] = x[50]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 6), (902, [None] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_inner_products(df, F.col("vec_id") % 20 == 0, 7, scale=64).collect()
    v = np.floor(np.float32(x).astype(np.float64) * 64).astype(np.int64)
    for q in range(0, 300, 20):
        s = v @ v[q]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:7]
        assert [(g.vec_id, g.score) for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == [(i, s[i]) for i in want]


def test_decontamination(spark):
    item = words(30, 9)
    near = [w if i % 9 != 4 else "new" for i, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(words(9, 10))), (3, None), (4, "too short")], "item_id long, text string")
    rows = [(1, "pre " + " ".join(item) + " post"), (2, " ".join(near)), (3, " ".join(words(9, 10))), (4, " ".join(words(80, 11))), (5, None), (6, "too short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = {r.doc_id: [(o.item_id, o.matched) for o in r.overlaps] for r in decontaminate.find_overlaps(df, bench).collect()}
    assert got[1] == [(1, 30)] and got[2][0][0] == 1 and got[3] == [(2, 9)] and not got[4] + got[5] + got[6]


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\n\nc\ny"), (3, None), (4, ""), (5, "a\nb"), (2, "x\na\nb\n\nc\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = Counter((r.doc_id, r.text, r.id) for r in line_dedup.remove_repeated_lines(df).collect())
    assert got == Counter([(1, "a\nb\nc\nd", "clash"), (2, "x\n\ny", "clash"), (2, "x\n\ny", "clash"), (3, None, "clash"), (4, "", "clash"), (5, "a\nb", "clash")])


def test_passages(spark):
    shared = words(60, 20)
    rows = [(k, " ".join([*words(50, 100 + k), *shared, *words(40, 200 + k)])) for k in range(4)] + [(9, " ".join(words(90, 300))), (10, None), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(df)
    got = found.collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3} and {r.doc_id for r in got if r.removed} == {1, 2, 3}
    left = {r.doc_id: len((r.text or "").split()) for r in passages.without_passages(df, found).collect()}
    # cut places lie inside of the passage: its edges may stay, or go with a few words beside them
    assert left[0] == 150 and all(80 <= left[k] <= 130 for k in (1, 2, 3)) and left[9] == 90


def test_quotes(spark):
    rows = [(1, 0, "u", "How do I build this thing?"), (1, 1, "a", "With the make tool, of course."), (1, 2, "u", "> How do I build this thing?\nI meant another thing."), (1, 3, "a", "> > How do I build this thing?\n> I meant another thing.\nAh, that one."), (2, 0, "u", None), (None, 0, "u", "> x"), (1, None, "u", "y")]
    got = {(r.conv_id, r.turn): r for r in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t].parent_turn for t in range(4)] == [None, 0, 0, 2]
    assert got[1, 3].text == "Ah, that one." and got[2, 0].text is None and got[None, 0].path == ""
    assert got[1, 2].run_start == 2 and got[1, 3].run_start == 2 and got[1, 1].run_start == 0


def test_long_words_and_texts():
    text = "a" * 3_000_000 + " b " + "c d " * 500_000
    h, bounds = _text.hash_words(*_text.arrow_bytes(pa.array([text, None, "b"])))
    assert np.diff(bounds).tolist() == [1_000_002, 0, 1] and h[1] == h[-1]
