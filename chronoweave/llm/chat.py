"""Chat formatting of reply trees.

Messages form trees by their parent. Iterative self-joins, each twice as far as the one before,
give every message its depth and the score of its path; leaves are ranked in their tree, and each
chosen root-to-leaf path is formatted as one conversation.

Template: a turn is `<|role|>`, a newline, the text, `</s>` and a newline. Control strings inside
texts and roles get the sign U+241B and a 1 after their first character, the sign itself a 0 after
it; so no control string is left in a text, and taking the marks out gives the text back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, written

MARK = "␛"
CONTROL = re.compile(r"</?s>|\[/?INST\]|\[/?SYS\]|<</?SYS>>|<\||\|>")
_START = re.compile(f"(?={CONTROL.pattern}).")
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    return _START.sub(lambda m: m[0] + MARK + "1", text.replace(MARK, MARK + "0"))


def unescape(text: str) -> str:
    return text.replace(MARK + "1", "").replace(MARK + "0", MARK)


def format_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[int]]:
    """The conversation and the spans (start, end, start, end, ...) of texts under the loss mask."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"<|{escape(role)}|>\n", escape(text)
        out += [head, body, "</s>\n"]
        at += len(head)
        if role == loss_role:
            spans += [at, at + len(body)]
        at += len(body) + 5
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; what isn't one is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, path, depth, node) of the best `branches` leaves of each tree, one row for each message on a path.

    `messages` has tree, node, parent (null for a root) and score. A path's score is the sum of its
    messages'; ties go to the smaller leaf. A message whose parent doesn't exist is a root; a
    message that is its own ancestor is on no path. Text takes no part, so only ids are moved; the
    number of joins is the logarithm of the greatest depth.
    """
    key = ["tree", "node"]
    m = written(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    up = m.join(m.select(F.col("tree"), F.col("node").alias("parent"), F.lit(True).alias("known")), ["tree", "parent"], "left")
    up = written(up.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("depth")), "up0")
    # messages with a message 2^k above them go on; the others are done
    hops, done = [up.where("up is not null")], up.where("up is null")
    while not hops[-1].isEmpty() and len(hops) <= 40:  # what is left after 2^40 steps is a circle
        both = done.unionByName(hops[-1])
        far = both.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        nxt = hops[-1].join(far, ["tree", "up"])
        nxt = nxt.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("depth") + F.col("depth2")).alias("depth"))
        nxt = written(nxt, f"up{len(hops)}")
        hops.append(nxt.where("up is not null"))
        done = done.unionByName(nxt.where("up is null"))
    whole = done
    parents = hops[0].select("tree", F.col("up").alias("node")).distinct()
    leaves = whole.join(parents, key, "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("node"))
    best = leaves.withColumn("path", F.row_number().over(rank)).where(F.col("path") <= branches)
    out = written(best.select("tree", F.col("node").alias("leaf"), "path", "node"), "on-path0")
    for k, step in enumerate(reversed(hops)):
        more = out.join(step.select("tree", "node", "up"), key).select("tree", "leaf", "path", F.col("up").alias("node"))
        new = written(out.union(more), f"on-path{k + 1}")
        discard(out)
        out = new
    depth = whole.select("tree", "node", "depth")
    return out.join(depth, key).select("tree", "leaf", "path", "depth", "node")


FORMATTED = "tree long, leaf long, path int, formatted string, loss array<long>"


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, path, formatted, loss): the chosen paths of reply trees as conversations.

    `messages` has tree, node, parent, score, role and text; (tree, node) is unique and node isn't
    null. Null role and text are empty; a null tree is a tree of its own. loss has the spans, in code
    points, of the assistant's texts. Extra columns are left out; an empty table gives none.
    """
    tree = F.struct(F.col("tree").isNull().alias("none"), F.coalesce("tree", F.lit(0)).alias("id"))
    m = messages.where("node is not null").select(tree.alias("tree"), "node", "parent", "score", "role", "text")
    paths = chosen_paths(m, branches)
    turns = paths.join(m.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.groupBy("tree", "leaf", "path").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "role", "text"))).alias("turns"))
    turns = turns.select(F.when(~F.col("tree.none"), F.col("tree.id")).alias("tree"), "leaf", "path", "turns")

    def run(batches):
        for b in small_batches(batches):
            rows = [format_turns([(t["role"] or "", t["text"] or "") for t in x]) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["tree", "leaf", "path", "formatted", "loss"])

    return turns.mapInArrow(run, FORMATTED)


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees: each row answers the one before it, by turn,
    then role and text where turns are equal. A row scores the length of its text and one.

    A conversation might have ended a turn before: beside its last row stands a leaf without text, an
    end, which scores -1. So each tree branches there, and the ranking finds the path through all rows.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order).cast("long")).withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    none = F.lit(None).cast("string")
    own = F.struct((2 * F.col("n")).alias("node"), (F.coalesce(F.length("text"), F.lit(0)) + 1).alias("score"), "role", "text")
    end = F.struct((2 * F.col("n") + 1).alias("node"), F.lit(-1).alias("score"), none.alias("role"), none.alias("text"))
    rows = rows.withColumn("x", F.explode(F.when(F.col("last") & (F.col("n") > 1), F.array(own, end)).otherwise(F.array(own))))
    return rows.select(F.col("conv_id").cast("long").alias("tree"), "x.node", F.when(F.col("n") > 1, 2 * F.col("n") - 2).alias("parent"), "x.score", "x.role", "x.text")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """What reading formatted conversations back gives: turns, and all text under the loss mask, unescaped."""

    def run(batches):
        for b in small_batches(batches):
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(spans[::2], spans[1::2], strict=True))
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [x.split()[0] for x in DIGEST.split(", ")])

    return formatted.select("tree", "formatted", "loss").mapInArrow(run, DIGEST)
