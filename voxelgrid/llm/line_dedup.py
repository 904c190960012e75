"""Removal of repeated lines by overlapping windows of three lines, in DataFrame functions only.

Lines that are not blank are hashed; each three consecutive ones form a window. Of windows
that occur more than once in all texts, every occurrence but the first (by id, then by place)
is repeated, and a line goes if any repeated occurrence covers it.

Contracts
* texts with under three lines that are not blank have no windows and stay as they are.
* null text stays null. Blank lines stay. Lines compare without spaces at their ends.
* rows that repeat both id and text count as one document and get the same result; null ids
  come first.
* all columns pass through; columns that have an output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import written

WINDOW = 3
#: A frequent window's occurrences are dealt over so many parts in the join.
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _solid(lines: Column) -> Column:
    """Place and hash of each line that is not blank."""
    one = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.xxhash64(F.trim(x)).alias("h"), (F.length(F.trim(x)) > 0).alias("solid")))
    return F.filter(one, lambda s: s["solid"])


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(id, k, at, w1, w2): each window's first line and its 128-bit hash."""
    solid = docs.select("id", "k", _solid(_lines(F.col("text"))).alias("s")).where(F.size("s") >= window)
    rows = solid.select("id", "k", F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - window), lambda p: F.struct(p.alias("at"), F.slice("s", p + 1, window).alias("l")))).alias("w"))
    hashes = [F.col("w.l")[j]["h"] for j in range(window)]
    return rows.select("id", "k", F.col("w.at").alias("at"), F.xxhash64(*hashes).alias("w1"), F.xxhash64(F.lit(7), *reversed(hashes)).alias("w2"))


def remove_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, out: str = "text", removed_col: str | None = None) -> DataFrame:
    """Replaces the text by its lines that no repeated window covers.

    ``removed_col`` names a further column for the number of lines removed.
    """
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.withColumn("k", F.xxhash64("text", "id"))
    windows = written(_windows(own, window).distinct())
    repeated = windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "k", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = repeated.select(F.col("w1").alias("r1"), F.col("w2").alias("r2"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    dealt = windows.withColumn("p", F.pmod(F.xxhash64("k", "at"), F.lit(SALTS)).cast("int"))
    same = (F.col("w1") == F.col("r1")) & (F.col("w2") == F.col("r2")) & (F.col("p") == F.col("part"))
    later = dealt.join(repeated, same).where(~F.struct("id", "k", "at").eqNullSafe(F.col("first")))
    gone = later.groupBy("id", "k").agg(F.collect_set("at").alias("ats"))
    gone = gone.select(F.col("id").alias("gid"), F.col("k").alias("gk"), "ats")
    joined = own.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("k") == F.col("gk")), "left")
    lines = _lines(F.col("text"))
    parts = joined.withColumns({"lines": lines, "solid": F.when(F.col("ats").isNotNull(), _solid(lines))})
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda p: F.sequence(p, p + (window - 1)))))
    places = F.transform(covered, lambda r: F.col("solid")[r]["i"])
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), places)
    kept = F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n")
    text = F.when(F.col("ats").isNull(), F.col("text")).otherwise(kept)
    outs = {out: text} | ({removed_col: F.when(F.col("ats").isNull(), 0).otherwise(F.size(covered))} if removed_col else {})
    names = [c for c in docs.columns if c not in outs]
    order = [*docs.columns, *(c for c in outs if c not in docs.columns)]
    # in a step of their own: beside an input's column "solid", a lambda would take that one
    parts = parts.select("row", F.struct(*(v.alias(c) for c, v in outs.items())).alias("new"))
    return parts.select(*(F.col("row")[c].alias(c) for c in names), *(F.col("new")[c].alias(c) for c in outs)).select(*order)
