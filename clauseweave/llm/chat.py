"""Chat formatting of reply trees.

Messages point at the message they answer.  Self-joins double each pointer: after k rounds a
message knows its 2**k-th ancestor, the sum of scores on the way and its depth, so a tree of
depth d takes about log2(d) rounds, however long its replies chain.  Leaves are the ends of
root-to-leaf paths; a tree's branches are ranked by mean score, and only the chosen paths are
laid out, by the same pointers read from the longest to the shortest: each round doubles the
known messages of a path.  Texts are joined once, to the chosen paths.

Template: a turn is ``### Role:``, a line break, the text, ``</turn>`` and a line break.  A
backslash, ``###`` and ``</turn>`` inside a text get a backslash before them, so neither mark
occurs bare in a text and reading back is exact.  The known roles are written ``System``,
``User`` and ``Assistant``; any other is written after ``=``, escaped likewise, its line
breaks and colons too.  The loss mask is the span of each assistant text (as escaped).

Defined cases: a null text is an empty one, a null role is an empty one; a message whose
parent is null or missing is a root; messages on a cycle of parents have no root and are left
out; a repeated id keeps the message with the smallest parent (none last), role, text and
score; a null id takes no part; a null score counts as 0; equal branches go to the smaller
leaf; a tree id may be null; a text is formatted whole, however long, and a path makes one
row; input columns beyond the named ones are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
SPOKEN = "assistant"
OPEN, CLOSE, SHUT = "### ", ":\n", "</turn>\n"

_CONTROL = r"\\|###|</turn>"
_HEAD = r"\\|###|</turn>|:|\n"
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


def escaped(text: Column, control: str = _CONTROL) -> Column:
    return F.regexp_replace(text, control, r"\\$0")


def header(role: Column) -> Column:
    """The name that opens a turn of ``role``."""
    name = F.concat(F.lit("="), escaped(role, _HEAD))
    for known, written in ROLES.items():
        name = F.when(role == known, F.lit(written)).otherwise(name)
    return F.concat(F.lit(OPEN), name, F.lit(CLOSE))


# --- paths


def branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, depth, id, place): the messages of each tree's ``best`` branches.

    ``messages`` is (tree, id, parent, score); ``place`` counts from the root (0).
    """
    rows = messages.filter("id IS NOT NULL").select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = rows.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    level = rows.join(known, "parent", "left").select(
        "tree", "id", F.when(F.col("_known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")
    )
    level = reliable(level)
    levels = []
    # a chain of all messages is the longest there can be
    most = level.count().bit_length() + 1
    while level.filter("up IS NOT NULL").take(1) and len(levels) < most:
        levels.append(level)
        above = level.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("steps").alias("_steps"))
        open_ = level.filter("up IS NOT NULL").join(above, "up").select(
            "tree", "id", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("steps") + F.col("_steps")).alias("steps")
        )
        level = reliable(open_.unionByName(level.filter("up IS NULL")))
    # what still points upwards lies on a cycle
    rooted = level.filter("up IS NULL")
    first = levels[0] if levels else level
    leaves = rooted.join(first.select(F.col("up").alias("id")).filter("id IS NOT NULL").distinct(), "id", "left_anti")
    score = F.col("total") / F.col("steps")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    chosen = leaves.select("tree", F.col("id").alias("leaf"), score.alias("score"), F.col("steps").alias("depth"))
    chosen = reliable(chosen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best))
    path = chosen.select("leaf", F.col("leaf").alias("id"))
    for known in reversed(levels):
        jumps = known.filter("up IS NOT NULL").select("id", "up")
        path = reliable(path.unionByName(path.join(jumps, "id").select("leaf", F.col("up").alias("id"))))
    placed = path.join(rooted.select("id", (F.col("steps") - 1).alias("place")), "id")
    return placed.join(chosen, "leaf").select("tree", "leaf", "rank", "score", "depth", "id", "place")


def replies(messages: DataFrame) -> DataFrame:
    """Messages (tree, id, parent, role, text, score), one for each id."""
    order = F.struct(F.col("parent").isNull().alias("none"), "parent", "role", "text", "score", "tree")
    one = messages.filter("id IS NOT NULL").groupBy("id").agg(F.min(order).alias("m"))
    return one.select("m.tree", "id", "m.parent", "m.role", "m.text", "m.score")


# --- formatting


def formatted(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, n_turns, formatted, loss): the chosen paths of each tree as conversations.

    ``messages`` is (tree, id, parent, role, text, score); ``loss`` holds the spans
    (code points, end exclusive) of the assistant's texts in ``formatted``.
    """
    rows = reliable(replies(messages))
    paths = branches(rows, best)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = rows.select("id", header(role).alias("head"), escaped(text).alias("body"), (role == SPOKEN).alias("spoken"))
    turns = paths.join(said, "id")
    length = F.char_length("head") + F.char_length("body") + F.lit(len(SHUT))
    before = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length.cast("long")).over(before), F.lit(0)) + F.char_length("head")
    spans = turns.withColumn("start", start).withColumn("end", F.col("start") + F.char_length("body"))
    one = spans.groupBy("leaf").agg(
        *[F.first(c).alias(c) for c in ("tree", "rank", "score")],
        F.array_sort(F.collect_list(F.struct("place", "head", "body", "spoken", "start", "end"))).alias("turns"),
    )
    loss = F.transform(F.filter("turns", lambda t: t["spoken"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(SHUT))), "")
    return one.select("tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"), whole.alias("formatted"), loss.alias("loss"))


# --- reading back

_NAMES = {written: role for role, written in ROLES.items()}
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:|\n)")
_READ = re.compile(r"### ((?:[^\\:\n]++|\\(?:\\|###|</turn>|:|\n))*+):\n((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turns_of(conversation: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(conversation):
        turn = _READ.match(conversation, at)
        if turn is None:
            raise ValueError(f"no turn begins at character {at}")
        name = turn[1]
        out.append((unescaped(name[1:]) if name.startswith("=") else _NAMES[name], unescaped(turn[2])))
        at = turn.end()
    return out


def read_back(conversations: DataFrame) -> DataFrame:
    """Rows of :func:`formatted` with ``turns`` (role, text) and ``loss_text`` read from the output."""

    def read(whole: pa.Array, spans: pa.Array) -> pa.Array:
        turns, loss = [], []
        for text, part in zip(whole.to_pylist(), spans.to_pylist(), strict=True):
            turns.append([{"role": role, "text": said} for role, said in turns_of(text)])
            loss.append("".join(unescaped(text[s["start"] : s["end"]]) for s in part))
        return pa.StructArray.from_arrays([pa.array(turns, pa.list_(_TURN)), pa.array(loss, pa.string())], ["turns", "loss_text"])

    found = F.arrow_udf(read, "struct<turns:array<struct<role:string,text:string>>,loss_text:string>")
    return conversations.withColumn("_read", found("formatted", "loss")).select(*conversations.columns, "_read.turns", "_read.loss_text")
