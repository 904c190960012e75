"""Exact top-k inner products by the threshold algorithm.

Candidates are dealt over blocks. In a block their components are kept as one sorted list per
dimension. A query walks the lists from the end that suits the sign of its weight, scores
each vector it meets for the first time, and stops when its kth score is above the bound that
the lists' current components allow for anything not met yet (equal scores may still hold a
smaller id, so equality goes on).

Each query walks its home block first. The kth score that it has from there goes with it to
the other blocks, where it fixes beforehand how deep the query has to go: not at all, where
already the tops of the lists bound the block below it. Where that depth has the lists of all
dimensions together longer than the block, every row would be met, and the block's rows are
scored as one matrix product instead of list by list.

Contracts
* vectors that are null, or hold a null or non-finite component, take no part.
* vectors of different lengths compare as if padded with zeros.
* ties go to the smaller id; rows of a query's own id are no candidates for it.
* null ids take no part. Fewer candidates than k: all of them. An empty table gives no rows.
* query rows that repeat an id and a vector ask once; of one id with several vectors each
  vector is a query with ranks of its own. Repeated candidates are ranked each.
* other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

QUERIES_PER_PART = 8192
CANDIDATES_PER_PART = 8192
#: Scores of one matrix product.
SCORES_AT_ONCE = 1 << 21


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * component), computed in doubles, as doubles."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))


def _usable(vector: str) -> Column:
    odd = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True))


class SortedLists:
    """One list of rows per dimension, descending; the other direction reads it backwards."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.rows = np.argsort(-x, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(x, self.rows, 0)
        n, dims = x.shape
        self.depths = [0, *(1 << k for k in range(n.bit_length()) if 1 << k < n)]
        #: From this level on the lists together are as long as the block.
        self.whole = next((k for k, d in enumerate(self.depths) if d * dims >= n), len(self.depths))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that a row can score that is met nowhere above each depth, for each query."""
        first = [max(d - 1, 0) for d in self.depths]
        return np.maximum(q, 0) @ self.values[first].T + np.minimum(q, 0) @ self.values[[-1 - d for d in first]].T

    def top(self, q: np.ndarray, k: int, least: np.ndarray, own: list[np.ndarray]) -> tuple[list, int]:
        """(rows, scores) of each query's k best rows that score ``least`` at least, and the number of rows scored.

        ``own``: rows that are no candidates of the query.
        """
        found: list = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        scored, bounds, rest = 0, self.bounds(q), []
        for i in range(len(q)):
            # a query without a kth score yet walks, too: its first rows may give it one
            if least[i] > -np.inf and (self.whole >= len(self.depths) or least[i] <= bounds[i, self.whole]):
                if least[i] <= bounds[i, 0]:
                    rest.append(i)
                continue
            one = self._walk(q[i], k, least[i], own[i], bounds[i])
            if one is None:
                rest.append(i)
            else:
                found[i] = one[:2]
                scored += one[2]
        step = max(1, SCORES_AT_ONCE // max(1, len(self.x)))
        for at in range(0, len(rest), step):
            some = rest[at : at + step]
            scores = q[some] @ self.x.T
            scored += scores.size
            for i, s in zip(some, scores, strict=True):
                s[own[i]] = -np.inf
                floor = max(least[i], np.partition(s, -k)[-k]) if len(s) > k else least[i]
                rows = np.flatnonzero((s >= floor) & (s > -np.inf))
                best = rows[np.lexsort((rows, -s[rows]))[:k]]
                found[i] = best, s[best]
        return found, scored

    def _walk(self, q, k, least, own, bounds):
        """The k best rows and the number scored, or None where the lists would have to be read to their ends."""
        met = np.zeros(len(self.x), bool)
        met[own] = True
        up = np.flatnonzero(q < 0)
        rows, scores, kth, count = np.zeros(0, np.int64), np.zeros(0), least, 0
        for level in range(len(self.depths)):
            if kth > bounds[level]:
                return rows, scores, count
            if level + 1 > self.whole or level + 1 >= len(self.depths):
                return None
            a, z = self.depths[level], self.depths[level + 1]
            read = self.rows[a:z]
            if len(up):
                read = read.copy()
                read[:, up] = self.rows[len(self.x) - z : len(self.x) - a, up]
            new = np.unique(read)
            new = new[~met[new]]
            met[new] = True
            count += len(new)
            s = self.x[new] @ q
            good = s >= kth
            rows, scores = np.concatenate([rows, new[good]]), np.concatenate([scores, s[good]])
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
            kth = max(kth, scores[-1]) if len(rows) == k else kth
        return None


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    x = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))))
    x[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return x


def _answer(batches, k: int):
    """(query_id, key, vec_id, score) of one block's candidates for the queries that came to it."""
    found = list(batches)
    if not found:
        return
    table = pa.Table.from_batches(found).sort_by("id")
    ids, asks, answers = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "asks", "answers"))
    x = _matrix(table.column("v"))
    asking, owner = np.flatnonzero(asks), ids[answers]
    if not len(asking) or not len(owner):
        return
    least = table.column("least").fill_null(-np.inf).to_numpy()[asking]
    own = [np.arange(np.searchsorted(owner, i), np.searchsorted(owner, i, "right")) for i in ids[asking]]
    best, _ = SortedLists(x[answers]).top(x[asking], k, least, own)
    n = [len(r) for r, _ in best]
    key = table.column("key").to_numpy()[asking]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(ids[asking], n)), pa.array(np.repeat(key, n)), pa.array(owner[np.concatenate([r for r, _ in best])]), pa.array(np.concatenate([s for _, s in best]))],
        names=["query_id", "key", "vec_id", "score"],
    )


def top_inner_products(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best other rows.

    With ``scale``, components are first turned into floor(scale * x) and scores are whole numbers.
    """
    value = quantised(vector_col, scale) if scale else F.col(vector_col).cast("array<double>")
    rows = vectors.where(_usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), value.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    total, queries = rows.agg(F.count("*"), F.count_if("q")).first()
    across, down = max(1, math.ceil(queries / QUERIES_PER_PART)), max(1, math.ceil(total / CANDIDATES_PER_PART))
    rows = rows.withColumn("key", F.xxhash64("v")).withColumn("p", F.pmod(F.xxhash64("id", "key"), F.lit(down)).cast("int"))
    kind = "query_id long, key long, vec_id long, score double"
    columns = ["id", "key", "v", "asks", "answers", "least"]
    none = F.lit(None).cast("double")
    candidates = rows.select("id", "key", "v", F.lit(False).alias("asks"), F.lit(True).alias("answers"), none.alias("least"), "p")
    asking = rows.where("q").dropDuplicates(["id", "key", "p"])
    home = candidates.unionByName(asking.select("id", "key", "v", F.lit(True).alias("asks"), F.lit(False).alias("answers"), none.alias("least"), "p"))

    def run(batches):
        return _answer(batches, k)

    found = home.repartitionById(down, F.col("p")).select(*columns).mapInArrow(run, kind)
    if down > 1:
        found = written(found)
        kth = found.groupBy(F.col("query_id").alias("id"), "key").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        asking = asking.join(kth, ["id", "key"], "left")
        away = F.filter(F.sequence(F.lit(0), F.lit(down - 1)), lambda x: x != F.col("p"))
        g = F.pmod(F.xxhash64("key", "id"), F.lit(across)).cast("int")
        asking = asking.select("id", "key", "v", F.lit(True).alias("asks"), F.lit(False).alias("answers"), "least", g.alias("g"), F.explode(away).alias("p"))
        every = asking.unionByName(candidates.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))))
        cells = every.repartitionById(across * down, F.col("g") * down + F.col("p"))
        found = found.unionByName(cells.select(*columns).mapInArrow(run, kind))
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.col("score").cast("long") if scale else F.col("score")
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
