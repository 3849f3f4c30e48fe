"""Chat formatting: reply trees to root-to-leaf conversations, in one reversible template.

Paths come from iterative self-joins with doubling: level k holds each message's 2**k-th ancestor,
so a tree of depth d takes log2(d) joins to climb and as many to list the members of the chosen
paths.  Only ids and scores move in those joins; a text is shuffled once, with its path.

Template: every turn is ``<s>role\\n`` + text + ``</s>\\n``.  Inside roles and texts a backslash is
doubled and every control string gets a backslash after its first character, so a control string
in the output always is the template's own, and dropping the escapes gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

TURN_END = "</s>\n"
#: What follows the first character of the control strings <s> </s> [INST] [/INST]
#: <<SYS>> <</SYS>> <|im_start|> <|im_end|> <|endoftext|>.
CONTROL = r"([<\[])(/?s>|/?INST\]|</?SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"


def escape(text: Column) -> Column:
    """Null counts as empty."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    pieces = F.transform(F.split(role, r"\\\\"),
                         lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit("")))
    return F.array_join(pieces, "\\")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed back from a formatted conversation."""
    parts = F.split(formatted, TURN_END)
    kept = F.filter(parts, lambda p, i: i < F.size(parts) - 1)
    return F.transform(kept, lambda p: F.struct(
        _unescape_role(F.substring_index(F.substr(p, F.lit(4)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text")))


def chain(turns: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Rows of a linear conversation as a reply tree: each row answers the one before it.

    Adds node_id and parent_id (null for the first).  Ties in ``order`` should be broken by its
    last columns; rows equal in all of them are interchangeable.
    """
    at = F.row_number().over(Window.partitionBy(tree).orderBy(*order)).cast("long")
    return turns.withColumn("node_id", at).withColumn(
        "parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1))


def reply_paths(messages: DataFrame, scratch: Scratch, tree: str = "tree_id", branches: int | None = None) -> DataFrame:
    """(tree, path_rank, path_score, leaf_id, node_id, depth) for every message of the chosen paths.

    messages: tree, node_id, parent_id, score.  A parent that is null or missing makes a root; a
    null score counts as 0; rows that repeat a (tree, node_id) are one message, the least by
    (parent_id, score); null node ids are ignored, a null tree is a tree.  Messages on or below a
    cycle have no root and so no path.  Paths rank by total score, then smaller leaf id;
    ``branches`` keeps that many per tree, None keeps all.  depth counts from the root, 0.
    """
    t = messages.where("node_id IS NOT NULL").select(
        F.to_json(F.struct(F.col(tree).alias("t"))).alias("_t"), F.col(tree).alias("_tree"), "node_id", "parent_id",
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    t = t.groupBy("_t", "node_id").agg(F.first("_tree").alias("_tree"),
                                       F.min(F.struct("parent_id", "score")).alias("m"))
    t = t.select("_t", "_tree", "node_id", "m.parent_id", "m.score")
    known = t.select("_t", F.col("node_id").alias("parent_id"), F.lit(True).alias("has"))
    level = scratch.table(
        t.join(known, ["_t", "parent_id"], "left")
        .select("_t", "_tree", "node_id", F.when(F.col("has"), F.col("parent_id")).alias("up"),
                F.col("score").alias("total"), F.lit(1).cast("long").alias("hops")), "level")
    first = level
    jumps = []
    rows = level.count()
    while level.where("up IS NOT NULL").limit(1).count():
        if 1 << len(jumps) > rows:
            break  # deeper than there are messages: what still climbs runs in a cycle
        jumps.append(level)
        above = level.select("_t", F.col("node_id").alias("up"), F.col("up").alias("up2"),
                             F.col("total").alias("total2"), F.col("hops").alias("hops2"))
        level = scratch.table(
            level.join(above, ["_t", "up"], "left")
            .select("_t", "_tree", "node_id", F.col("up2").alias("up"),
                    (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"),
                    (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops")), "level")
    parents = first.where("up IS NOT NULL").select("_t", F.col("up").alias("node_id"))
    leaves = level.where("up IS NULL").join(parents, ["_t", "node_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("_t").orderBy(F.desc("total"), "node_id"))
    leaves = leaves.withColumn("path_rank", rank)
    if branches is not None:
        leaves = leaves.where(F.col("path_rank") <= branches)
    member = scratch.table(leaves.select(
        "_t", "_tree", "path_rank", F.col("total").alias("path_score"), F.col("node_id").alias("leaf_id"), "node_id",
        (F.col("hops") - 1).alias("depth")), "paths")
    for k in reversed(range(len(jumps))):
        step = jumps[k].where("up IS NOT NULL").select("_t", "node_id", "up")
        higher = member.join(step, ["_t", "node_id"]).select(
            "_t", "_tree", "path_rank", "path_score", "leaf_id", F.col("up").alias("node_id"),
            (F.col("depth") - F.lit(1 << k)).alias("depth"))
        member = scratch.table(member.union(higher), "paths")
    return member.withColumnRenamed("_tree", tree)


def format_conversations(messages: DataFrame, tree: str = "tree_id", branches: int | None = None,
                         loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, path_rank, path_score, leaf_id, formatted, segments.

    messages: tree, node_id, parent_id, role, text and, if present, score (see ``reply_paths``);
    other columns are ignored.  segments: array<struct<text, loss>> whose texts joined are
    ``formatted``; loss is true for exactly the texts of ``loss_role``.  Null roles and texts are
    empty.  A conversation, however long, is one row; nothing larger is ever gathered.
    """
    if "score" not in messages.columns:
        messages = messages.withColumn("score", F.lit(None).cast("double"))
    messages = messages.select(tree, "node_id", "parent_id", "score", "role", "text")
    scratch = Scratch(messages.sparkSession, "chat")
    paths = reply_paths(messages, scratch, tree, branches)
    said = messages.where("node_id IS NOT NULL").select(
        F.to_json(F.struct(F.col(tree).alias("t"))).alias("_t"), "node_id",
        F.struct("parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)), "role", "text").alias("m"))
    said = said.groupBy("_t", "node_id").agg(F.min("m").alias("m"))
    turn = paths.join(said, ["_t", "node_id"]).select(
        "_t", tree, "path_rank", "path_score", "leaf_id",
        F.struct("depth",
                 F.concat(F.lit("<s>"), _escape_role(F.col("m.role")), F.lit("\n")).alias("head"),
                 escape(F.col("m.text")).alias("body"),
                 F.coalesce(F.col("m.role") == loss_role, F.lit(False)).alias("loss")).alias("turn"))
    rows = turn.groupBy("_t", "leaf_id").agg(
        F.first(tree).alias(tree), F.first("path_rank").alias("path_rank"), F.first("path_score").alias("path_score"),
        F.sort_array(F.collect_list("turn")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
        F.struct(F.lit(TURN_END).alias("text"), F.lit(False).alias("loss")))))
    return rows.select(tree, "path_rank", "path_score", "leaf_id", segments.alias("segments")).select(
        tree, "path_rank", "path_score", "leaf_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")
