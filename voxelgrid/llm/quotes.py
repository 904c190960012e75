"""Conversations in reply order, from quotations.

Lines that begin with ``>`` marks are quotes; the marks give the level. Neighbouring lines of
one level are a passage. Hashes of normalised passages, of their paragraphs and sentences
(both whatever their line breaks) and lines are joined with those of what earlier messages of
the conversation wrote themselves; a message replies to the message that it quotes most (the
latest of these). Short ones count as well as long ones, where they have a letter or digit.
A message without a known quote replies to the one of the turn before. Quotes are dropped.

A message that answers the turn before continues a run; any other begins one. Reply order
visits a message, then what continues it, then its other replies by turn. It is given as
``position`` in the conversation, from 0, and as a sort key: ``path`` (the branch points on
the way to the run, in hexadecimal digits of fixed width that sort as text) and ``turn``.

Contracts
* rows with a null conversation or turn have no parent, no position and an empty path; null text stays null.
* rows that repeat a conversation and turn share parent, path and position.
* messages that are quoted equally often: the latest is the parent.
* a message whose quotes are all its text keeps an empty text. Other columns pass through;
  those that have an output's name are replaced. An empty table gives no rows.
* rows come sorted by conversation and position.
"""

from __future__ import annotations

import re
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import tasks_for, written

_MARKS = re.compile(r"^\s*((?:>\s?)+)")
_SENTENCE = re.compile(r"(?<=[.!?\u3002\uff01\uff1f])[\"')\]\u201d\u2019]*\s+|(?<=[\u3002\uff01\uff1f])")
_BLANK = re.compile(r"\n\s*\n")
LINE = "array<struct<level:int,h:bigint>>"


def parse_levels(text: str) -> list[tuple[int, str]]:
    """(quote level, rest of the line) of each line."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normalised(line: str) -> str:
    return "".join(c for c in line.casefold() if c.isalnum())


def pieces(levels: list[tuple[int, str]]) -> set[tuple[int, str]]:
    """(level, normalised text) of the passages, paragraphs, sentences and lines."""
    out = set()
    for level, run in groupby(levels, key=lambda x: x[0]):
        passage = "\n".join(x for _, x in run)
        out.add((level, normalised(passage)))
        out.update((level, normalised(x)) for x in passage.split("\n"))
        for paragraph in _BLANK.split(passage):
            out.add((level, normalised(paragraph)))
            out.update((level, normalised(x)) for x in _SENTENCE.split(paragraph))
    return {(level, k) for level, k in out if k}


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``own`` (the text without quotes) and ``lines`` (level and hash of each passage, paragraph, sentence and line)."""
    schema = T.StructType([*messages.schema.fields, T.StructField("own", T.StringType()), T.StructField("lines", T._parse_datatype_string(LINE))])

    def run(batches):
        for b in batches:
            own, lines = [], []
            for text in b.column(b.schema.get_field_index(text_col)).to_pylist():
                if text is None:
                    own.append(None)
                    lines.append([])
                    continue
                levels = parse_levels(text)
                quoted = any(level for level, _ in levels)
                own.append("\n".join(x for level, x in levels if not level).strip("\n") if quoted else text)
                lines.append([(level, xxhash.xxh64_intdigest(k) - 2**63) for level, k in pieces(levels)])
            values = pa.array([[{"level": a, "h": h} for a, h in x] for x in lines], pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.string()), values], names=[*b.schema.names, "own", "lines"])

    return messages.mapInArrow(run, schema)


def reply_order(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """The messages without quotes, with parent_turn, run_start, path and position."""
    packed = messages.select(F.struct("*").alias("row"), F.col(conv_col).alias("_c"), F.col(turn_col).cast("long").alias("_t"), F.col(text_col).alias("text"))
    rows = written(parsed(packed).drop("text"))
    keyed = rows.where("_c is not null and _t is not null")
    lines = keyed.select("_c", "_t", F.explode("lines").alias("l")).select("_c", "_t", "l.level", "l.h").distinct()
    wrote = lines.where("level = 0").select(F.col("_c").alias("c"), F.col("_t").alias("source"), F.col("h").alias("k"))
    # the shallowest quotes speak of the message that is answered
    quoted = lines.where("level > 0")
    hits = quoted.join(wrote, (F.col("_c") == F.col("c")) & (F.col("h") == F.col("k")) & (F.col("source") < F.col("_t")))
    votes = hits.groupBy("_c", "_t", "source").agg(F.count("*").alias("n"), F.min("level").alias("level"))
    best = votes.groupBy("_c", "_t").agg(F.max(F.struct((-F.col("level")).alias("level"), "n", "source")).alias("b")).select("_c", "_t", F.col("b.source").alias("quoted"))
    turns = keyed.select("_c", "_t").distinct()
    before = turns.select("_c", (F.col("_t") + 1).alias("_t"), F.col("_t").alias("prior"))
    links = turns.join(before, ["_c", "_t"], "left").join(best, ["_c", "_t"], "left")
    links = written(links.select("_c", "_t", F.coalesce("quoted", "prior").alias("parent"), "prior"))
    # the start of each message's run, by doubling steps along continuing messages
    start = F.when(F.col("parent") == F.col("prior"), F.col("prior")).otherwise(F.col("_t"))
    jump = written(links.select("_c", "_t", start.alias("start")))
    done, moving = jump.where("start = _t"), jump.where("start <> _t")
    while not moving.isEmpty():
        on = done.unionByName(moving).select(F.col("_c").alias("c"), F.col("_t").alias("t"), F.col("start").alias("next"))
        moved = moving.join(on, (F.col("_c") == F.col("c")) & (F.col("start") == F.col("t")))
        moved = written(moved.select("_c", "_t", F.col("next").alias("start"), (F.col("next") != F.col("start")).alias("moved")))
        done = done.unionByName(moved.where("not moved").select("_c", "_t", "start"))
        moving = moved.where("moved").select("_c", "_t", "start")
    jump = done
    # runs and the branch points above them
    heads = links.join(jump, ["_c", "_t"]).where("_t = start")
    up = jump.select(F.col("_c").alias("c"), F.col("_t").alias("t"), F.col("start").alias("above"))
    runs = heads.join(up, (F.col("_c") == F.col("c")) & (F.col("parent") == F.col("t")), "left")
    point = F.struct(F.bitwise_not("parent").alias("after"), F.col("_t").alias("turn"))
    runs = written(runs.select("_c", F.col("_t").alias("start"), "above", F.when(F.col("above").isNotNull(), F.array(point)).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("after"), F.col("_t").alias("turn")))).alias("path")))
    while True:
        on = runs.select(F.col("_c").alias("c"), F.col("start").alias("t"), F.col("above").alias("next"), F.col("path").alias("more"))
        runs = written(runs.join(on, (F.col("_c") == F.col("c")) & (F.col("above") == F.col("t")), "left").select("_c", "start", F.col("next").alias("above"), F.coalesce(F.concat("more", "path"), "path").alias("path")))
        if runs.where("above is not null").isEmpty():
            break
    placed = links.join(jump, ["_c", "_t"]).join(runs.drop("above"), ["_c", "start"])
    digits = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    path = F.array_join(F.transform("path", lambda p: F.concat_ws(":", digits(p["after"]), digits(p["turn"]))), "/")
    placed = placed.select(F.col("_c").alias("c"), F.col("_t").alias("t"), "parent", "start", path.alias("path"))
    placed = _positions(placed)
    out = rows.join(placed, (F.col("_c") == F.col("c")) & (F.col("_t") == F.col("t")), "left").orderBy("_c", "position", "_t")
    outs = {"parent_turn": F.col("parent"), "run_start": F.col("start"), "path": F.coalesce("path", F.lit("")), "position": F.col("position")}
    kept = [c for c in messages.columns if c != text_col and c not in outs]
    return out.select(*(F.col("row")[c].alias(c) for c in kept), F.col("own").alias(text_col), *(v.alias(c) for c, v in outs.items()))


def _positions(placed: DataFrame) -> DataFrame:
    """Adds each message's position in its conversation's reply order.

    Rows are sorted over ranges that may cut a conversation; a range's rows of a conversation
    count from where those of the ranges before end. So no task holds a whole conversation.
    """
    ranged = placed.repartitionByRange(tasks_for(placed.sparkSession), "c", "path", "t").sortWithinPartitions("c", "path", "t")
    ranged = written(ranged.withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.shiftright("m", 33)))
    by = ranged.groupBy(F.col("c").alias("bc"), F.col("part").alias("bp")).agg(F.min("m").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("bc").orderBy("bp").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    both = ranged.join(by, (F.col("c") == F.col("bc")) & (F.col("part") == F.col("bp")))
    return both.withColumn("position", F.col("m") - F.col("first") + F.col("before")).select(*placed.columns, "position")
