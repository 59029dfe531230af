"""Chat formatting over reply trees.

Messages point to the message they reply to.  Iterative self-joins double the distance of ancestor
pointers, which gives every leaf its root, its depth and the sum of scores on its path in a number of
rounds that is the logarithm of the depth.  The best leaves of each tree are chosen by score, their
paths are enumerated with the same pointers, and each path becomes one conversation.

A turn is ``<s>[INST]role[/INST]text</s>``.  Control strings inside roles and texts are broken up by a
backslash, and backslashes are doubled, so ``</s>`` ends a turn wherever it stands and unescape()
restores every text.  loss_spans are the places (start, end in code points) of the assistant texts.

Defined results.  Null roles and texts are empty.  A parent that is missing makes a message a root;
messages on a cycle of parents belong to no path.  Of rows that share tree and node the least one (by
parent, role, text) counts.  A null tree is a tree of its own.  Equal scores fall to the smaller leaf.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import null_safe_key, write_table

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, r"<(/?s>)", r"<\\$1"), r"\[(/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_replies(rows: DataFrame, conversation: str, order: list[str], role: str = "role", text: str = "text") -> DataFrame:
    """Turns of conversations as messages, each a reply to the turn before it."""
    key = null_safe_key(F.col(conversation))
    in_order = Window.partitionBy("tree").orderBy(*order, role, text)
    numbered = rows.withColumn("tree", key).withColumn("node", F.row_number().over(in_order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score"))


def _pointers(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestor tables (tree, node, up) for distances 1, 2, 4 ..., and (tree, node, depth, total) of nodes under a root."""
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    first = messages.join(known, ["tree", "parent"], "left")
    level = write_table(first.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "pointers")
    levels = [level]
    limit = max(1, messages.count()).bit_length() + 1
    while len(levels) < limit and level.filter("up is not null").limit(1).count():
        above = level.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        joined = level.filter("up is not null").join(above, ["tree", "up"])
        more = joined.select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"))
        level = write_table(more.unionByName(level.filter("up is null")), "pointers")
        levels.append(level)
    return levels, level.filter("up is null").select("tree", "node", "depth", "total")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, path_score, place, node): the nodes, from the root, of each tree's best root-to-leaf paths.

    messages has tree (string), node (long), parent, role, text, score.
    """
    levels, rooted = _pointers(messages)
    parents = messages.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    chosen = leaves.withColumn("__rank", rank).filter(F.col("__rank") <= branches)
    path = chosen.select("tree", F.col("node").alias("leaf"), F.col("total").alias("path_score"), F.col("depth"), F.col("depth").alias("place"), "node")
    done = []
    for k, level in enumerate(levels[:-1]):
        path = write_table(path, "paths")
        done.append(path.filter(F.col("depth") <= (1 << k)))  # whole; only longer paths go on
        ups = level.select("tree", "node", "up")
        here = F.struct("place", "node")
        above = F.struct((F.col("place") - (1 << k)).alias("place"), F.col("up").alias("node"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, above))
        longer = path.filter(F.col("depth") > (1 << k)).join(ups, ["tree", "node"], "left")
        path = longer.select("tree", "leaf", "path_score", "depth", F.explode(both).alias("__at")).select("tree", "leaf", "path_score", "depth", "__at.place", "__at.node")
    for part in done:
        path = path.unionByName(part)
    return path.drop("depth")


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, path_score, n_turns, formatted, loss_spans array<struct<start, end>>."""
    least = messages.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("__m")).select("tree", "node", "__m.*")
    messages = write_table(least, "messages")
    turns = best_paths(messages, branches).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(BEGIN + OPEN), escape(F.col("role")), F.lit(CLOSE))
    turns = turns.withColumns({"__head": head, "__body": escape(F.col("text"))})
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("__head") + F.length("__body") + len(END)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("__head")
    turns = turns.withColumn("__start", start)
    span = F.when(F.col("role") == ASSISTANT, F.struct(F.col("__start").alias("start"), (F.col("__start") + F.length("__body")).alias("end")))
    turn = F.struct("place", F.concat("__head", "__body", F.lit(END)).alias("t"), span.alias("s"))
    whole = turns.groupBy("tree", "leaf").agg(F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(turn)).alias("__turns"))
    return whole.select("tree", "leaf", "path_score", F.size("__turns").cast("long").alias("n_turns"), F.array_join(F.transform("__turns", lambda t: t["t"]), "").alias("formatted"), F.array_compact(F.transform("__turns", lambda t: t["s"])).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    pieces = F.split(formatted, END.replace("/", "\\/"))
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece):
        inside = F.substring(piece, len(BEGIN + OPEN) + 1, 1 << 30)
        return F.struct(unescape(F.substring_index(inside, CLOSE, 1)).alias("role"), unescape(F.substring(inside, F.instr(inside, CLOSE) + len(CLOSE), F.lit(1 << 30))).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    parts = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(parts, "")
