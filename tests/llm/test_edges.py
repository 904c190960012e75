"""Empty tables, repeated rows, columns with clashing names, and very long texts, for operators with rows of documents, turns and vectors."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxelgrid.llm import bpe, language, line_dedup, quotes, topk

P = pytest.importorskip("public_tokenizers")
#: Names that operators use themselves.
CLASHES = ["id", "node", "row", "k", "h", "w", "u", "at", "n", "spans", "pid", "part", "shard", "train", "ids", "token_ids", "decoded", "score", "lang_pred", "component_id", "n_shingles", "overlaps", "chunk", "data", "first", "gid", "gk", "lines", "solid", "s", "words"]
BYTES = "byte_bpe_50k.json"


OPERATORS = {
    "bpe": (lambda d: bpe.decode(bpe.encode(d, P.path(BYTES)), P.path(BYTES)), "doc_id"),
    "line_dedup": (line_dedup.remove_repeated_lines, "doc_id"),
    "language": (lambda d: language.identify(d, language.fit(d)), "doc_id"),
}
PROSE = " ".join(f"word{i * 7 % 31}x{i % 13}" for i in range(70))
ROWS = [(1, PROSE, "en"), (1, PROSE, "en"), (2, PROSE + " tail", None), (None, "a b", "en"), (None, None, None), (3, "", "de"), (4, "line one\nline two\nline three\nline four", "de"), (5, "long " * 20_000, "de"), (6, "x" * 20_000, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(docs, name):
    assert OPERATORS[name][0](docs.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_once_and_clashing_names_change_nothing(docs, name):
    run, id_col = OPERATORS[name]
    plain = run(docs)
    wide = run(docs.withColumns({c: F.lit("clash") for c in CLASHES}))
    own = [c for c in plain.columns if c in wide.columns]

    def rows(df):
        return Counter(str([r[c] for c in own]) for r in df.collect())

    got = rows(plain)
    assert sum(got.values()) == len(ROWS) and id_col in own
    assert rows(wide) == got


def test_conversations(spark):
    rows = [(1, 0, "u", "Why so?"), (1, 0, "u", "Why so?"), (1, 1, "a", "> Why so?\nBecause."), (None, None, None, None), (2, 0, "u", "")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert quotes.reply_order(talk.where("false")).count() == 0
    plain = quotes.reply_order(talk)
    wide = quotes.reply_order(talk.withColumns({c: F.lit("clash") for c in [*CLASHES, "path", "parent", "start", "own", "c", "t", "_c", "_t"]}))
    own = ["conv_id", "turn", "parent_turn", "text"]
    got = Counter(str([r[c] for c in own]) for r in plain.collect())
    assert sum(got.values()) == len(rows) and Counter(str([r[c] for c in own]) for r in wide.collect()) == got


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [float("inf"), 0.0]), (None, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    run = lambda d: topk.top_inner_products(d, F.col("vec_id") % 20 == 0, 2, scale=64)
    assert run(df.where("false")).count() == 0
    wide = df.withColumns({c: F.lit("clash") for c in [*CLASHES, "query_id", "rank", "vector", "v", "q"]})
    assert Counter(map(tuple, run(wide).collect())) == Counter(map(tuple, run(df).collect()))
    assert [(r.rank, r.vec_id) for r in sorted(run(df.where("vec_id is not null")).collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
