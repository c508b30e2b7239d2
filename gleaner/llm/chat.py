"""Chat formatting: reply trees cut into root-to-leaf paths, each path one conversation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

# The template, fixed values. A turn is "### role: text </turn>\n"; a backslash stands before every backslash,
# "#", "<", ":" and line feed of a role, and before every backslash, "#" and "<" of a text, so that neither can hold
# the start or end of a turn, and dropping one backslash before each character that follows one gives the text back.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
LEARNED_ROLE = "assistant"


def escape(text: Column, more: str = "") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"([\\#<{more}])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


_TURN = re.compile(r"### ((?:[^\\#<:\n]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; raises if anything is left over."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation from character {at}")
    return out


def _held(tree: str) -> Column:
    """A tree's key in a struct, which is never null and equals another one where both keys are null."""
    return F.struct(F.col(tree).alias("key")).alias("tree")


def paths(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """Nodes of root-to-leaf paths of reply trees: tree, leaf, score, branch (rank in its tree, from 1), node, back.

    messages: tree, node, parent, score. back counts from the leaf (0) up to the root. A parent that is null, the node
    itself or not in the tree makes a root. Rows that repeat a node count once (the smallest parent and score). Null
    scores are 0; nodes whose tree is null make up one tree; a path's score is the sum over its nodes, and ties go to the smaller leaf. Nodes on a cycle have no
    root: they are on no path. keep: best branches a tree; None keeps all.

    Round j joins the nodes that have an ancestor 2^j steps up with that ancestor, so the rounds are as many as the
    depth has bits and nodes leave once they see their root. The chosen leaves then walk up through the same jumps,
    longest first: every node of a path is reached once, and no array of a path is carried along.
    """
    nodes = messages.groupBy(_held("tree"), "node").agg(F.min("parent").alias("parent"), F.min(F.coalesce("score", F.lit(0.0))).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    above = (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n")) & (F.col("parent") != F.col("node"))
    nodes = materialise(nodes.join(known, above, "left").select("tree", "node", F.col("n").alias("up"), "score"), "chat-nodes")
    leaves = nodes.select("tree", "node").join(nodes.where("up is not null").select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    deepest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, state = [], nodes
    while 1 << len(jumps) < deepest:
        going = state.where("up is not null")
        if going.isEmpty():
            break
        jumps.append(going.select("tree", "node", "up"))
        far = state.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("far"), F.col("score").alias("more"))
        step = going.join(far, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")))
        step = step.select("tree", "node", F.col("far").alias("up"), (F.col("score") + F.col("more")).alias("score"))
        state = materialise(state.where("up is null").unionByName(step), "chat-jumps")
    whole = state.where("up is null").join(leaves, ["tree", "node"], "left_semi")
    branch = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    whole = whole.select("tree", F.col("node").alias("leaf"), "score", branch.alias("branch"))
    chosen = materialise(whole if keep is None else whole.where(F.col("branch") <= keep), "chat-leaves")
    walked = chosen.withColumn("node", F.col("leaf")).withColumn("back", F.lit(0))
    for j in range(len(jumps) - 1, -1, -1):
        on = walked.join(jumps[j], ["tree", "node"]).select("tree", "leaf", "score", "branch", F.col("up").alias("node"), (F.col("back") + (1 << j)).alias("back"))
        walked = materialise(walked.unionByName(on), "chat-paths")
    return walked.withColumn("tree", F.col("tree.key"))


def format_paths(messages: DataFrame, steps: DataFrame) -> DataFrame:
    """One conversation for each path in steps (tree, leaf, branch, node, back): tree, leaf, branch, n_turns, formatted, loss_spans.

    messages: tree, node, role, text; null role or text is empty. loss_spans are [start, end) in code points of
    formatted, one for each text of LEARNED_ROLE, still escaped. Rows that repeat a node count once (the smallest
    role and text). Nodes whose tree is null make up one tree.
    """
    said = messages.groupBy(_held("tree"), "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    role = escape(F.col("m.role"), ":\n")
    turn = F.struct((-F.col("back")).alias("place"), (F.col("m.role") == LEARNED_ROLE).alias("learned"), F.concat(F.lit(OPEN), role, F.lit(AFTER_ROLE)).alias("head"), escape(F.col("m.text")).alias("body"))
    turns = steps.withColumn("tree", _held("tree")).join(said, ["tree", "node"]).select("tree", "leaf", "branch", turn.alias("turn"))
    rows = turns.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
            F.when(
                t["learned"],
                F.array_append(s["spans"], F.struct((s["at"] + F.length(t["head"])).alias("start"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return rows.select(F.col("tree.key").alias("tree"), "leaf", "branch", F.size("turns").alias("n_turns"), whole.alias("formatted"), spans.alias("loss_spans"))
