"""Language identification by word frequencies with back-off to character n-grams.

A known word scores by its log frequency in each language. An unknown word falls back to the
longest known character n-grams that cover it, from the longest length down to single
characters, each shorter step at a cost.

Contracts
* the model is fitted on at most about ``rows_per_language`` distinct labelled texts of each
  language (chosen by a hash of the text, copies once); prediction uses the whole text and
  nothing else. Its vectors lie in one array, not in an object for each word.
* null text, or text without a letter: ``und`` with score 0. Without any labelled row: ``und``.
* languages that score alike: the first in sorted order. Rows stand for themselves: repeated
  rows and ids give repeated results, empty tables none.
* all columns pass through; columns that have an output's name are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._worker import kept

ROWS_PER_LANGUAGE = 1500
GRAM = 5
#: Words whose evidence counts in a score; more evidence does not make it surer.
SURE = 12
BACK_OFF = 0.4
#: Chunks kept by a worker, and chunks of a text that are looked up together.
KEPT_WORDS, CHUNKS_AT_ONCE = 400_000, 50_000
_LETTERS = regex.compile(r"\p{L}+")


def _grams(word: str):
    w = f"^{word}$"
    for n in range(1, GRAM + 1):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", use: Column | None = None, rows_per_language: int = ROWS_PER_LANGUAGE, least: int = 2) -> dict:
    """The model: languages, and a vector of log frequencies for each word and n-gram."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if use is None else use))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    totals = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(totals)
    if not languages:
        none = _table([], np.zeros((0, 0), np.float32))
        return {"key": uuid.uuid4().hex, "languages": [], "words": none, "grams": none}
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / totals[k]))))
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).distinct()

    def count(batches):
        words: dict[tuple, int] = Counter()
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(_LETTERS.findall(text.lower())).items():
                    words[lang, w] += n
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in words]), pa.array([k[1] for k in words]), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    counted = drawn.mapInArrow(count, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    at = {k: i for i, k in enumerate(languages)}
    words: dict[str, list[float]] = {}
    grams: dict[str, list[float]] = {}
    for lang, word, n in zip(*(c.to_pylist() for c in counted.columns), strict=True):
        k = at[lang]
        if word not in words:
            words[word] = [0.0] * len(languages)
        words[word][k] += n
        for g in _grams(word):
            if g not in grams:
                grams[g] = [0.0] * len(languages)
            grams[g][k] += min(n, 20)
    w, g = list(words), [x for x, c in grams.items() if sum(c) > 2]
    counts, of_grams = (np.array([table[x] for x in names], np.float64).reshape(-1, len(languages)) for table, names in ((words, w), (grams, g)))
    size = np.array([len(x) for x in g], np.int64)
    total = np.ones((GRAM + 1, len(languages)))
    for n in range(1, GRAM + 1):
        total[n] += of_grams[size == n].sum(axis=0)
    return {
        "key": uuid.uuid4().hex,
        "languages": languages,
        "words": _table(w, _log(counts, counts.sum(axis=0), len(w))),
        "grams": _table(g, _log(of_grams, total[size], len(g))),
    }


def _log(counts: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """Log frequencies, relative to the mean over the languages and bounded."""
    v = np.log((counts + 0.1) / (total + 0.1 * kinds))
    return np.clip(v - v.mean(axis=1, keepdims=True), -4, 4).astype(np.float32)


def _table(names: list[str], values: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Names and their rows of values, as two arrays."""
    return pa.array(names, pa.string()), values


class _Scores(dict):
    """Row of each whitespace-delimited chunk in a growing table of score vectors."""

    def __init__(self, model: dict):
        super().__init__()
        self.size = len(model["languages"])
        self.names = model["languages"]
        self.words, self.grams = ({x: i for i, x in enumerate(model[k][0].to_pylist())} for k in ("words", "grams"))
        self.of_word, self.of_gram = model["words"][1], model["grams"][1]
        self.table = np.zeros((1024, self.size + 1), np.float32)

    def word(self, w: str) -> np.ndarray:
        row = self.words.get(w)
        if row is not None:
            return self.of_word[row]
        grams, text, i, rows, weights = self.grams, f"^{w}$", 0, [], []
        while i < len(text):
            for k in range(min(GRAM, len(text) - i), 0, -1):
                row = grams.get(text[i : i + k])
                if row is not None:
                    rows.append(row)
                    weights.append(1 - BACK_OFF * (GRAM - k) / GRAM)
                    i += max(1, k - 1)
                    break
            else:
                i += 1
        return np.array(weights, np.float32) @ self.of_gram[rows] / len(rows) if rows else np.zeros(self.size, np.float32)

    def __missing__(self, chunk: str) -> int:
        row = len(self)
        if row >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for w in _LETTERS.findall(chunk.lower()):
            self.table[row, :-1] += self.word(w)
            self.table[row, -1] += 1
        self[chunk] = row
        return row


def _scores(model: dict) -> _Scores:
    """The worker's table for this model; tasks of one job share it."""
    return kept(("language", model["key"]), lambda: _Scores(model))


def _predict(scores: _Scores, text: str | None) -> tuple[str, float]:
    languages = scores.names
    chunks = (text or "").split()
    total = np.zeros(len(languages) + 1)
    for at in range(0, len(chunks), CHUNKS_AT_ONCE):
        if len(scores) > KEPT_WORDS:
            scores.clear()
            scores.table = np.zeros((1024, len(languages) + 1), np.float32)
        rows = [scores[c] for c in chunks[at : at + CHUNKS_AT_ONCE]]
        total += scores.table[rows].sum(axis=0, dtype=np.float64)
    words = total[-1]
    if not words or not languages:
        return "und", 0.0
    v = total[:-1] * (min(words, SURE) / words)
    p = np.exp(v - v.max())
    best = int(np.argmax(p))
    return languages[best], float(p[best] / p.sum())


def identify(docs: DataFrame, model: dict, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the predicted language and its score."""
    outs = (lang_out, score_out)
    schema = T.StructType([f for f in docs.schema if f.name not in outs] + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = _scores(shared.value)
        for b in batches:
            found = [_predict(scores, x.as_py()) for x in b.column(b.schema.get_field_index(text_col))]
            names = [n for n in b.schema.names if n not in outs]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(n)) for n in names), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*names, *outs],
            )

    return docs.mapInArrow(run, schema)
