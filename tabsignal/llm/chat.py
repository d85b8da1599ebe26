"""Chat formatting over reply trees, with DataFrame functions only.

Messages form trees by parent.  Pointer doubling - a self-join of each
message's jump pointer with itself - gives every message its root, depth and
the score summed from the root, in as many joins as the depth has binary
digits.  Leaves are ranked under their root by that score; the chosen leaves
then collect their ancestors by the same jumps, again in that many joins, so
each (path, message) pair is made once.  A path is formatted as one string
whose template marks turns and escapes control strings reversibly, with the
spans under the loss mask beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, saved

#: The template: ``<s>role\ntext</s>`` for each turn.
OPEN, CLOSE = "<s>", "</s>"
#: What stands for characters that could form a control string; & is escaped first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
#: Also escaped in roles, which end at the first new line.
ROLE_ESCAPES = (*ESCAPES, ("\n", "&nl;"))


def escape(text: Column, table=ESCAPES) -> Column:
    for plain, safe in table:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, table=ESCAPES) -> Column:
    for plain, safe in reversed(table):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def linear_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of conversations in which each turn answers the one before.

    Gives tree, node, parent, score, role, text.  Turns of one conversation
    that tie follow each other by role and text, so repeated rows all stay.
    Null roles and texts count as empty; rows of a null conversation form one.
    """
    rows = pick(turns, conv, turn, role, text)
    rows = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "role", "text")).cast("long")
    return rows.select("tree", at.alias("node"), F.when(at > 1, at - 1).alias("parent"), F.length("text").cast("double").alias("score"), "role", "text")


def _next(open_: DataFrame, every: DataFrame) -> DataFrame:
    """Jump pointers twice as long, of messages whose pointer is not yet past the root."""
    far = every.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("jump").alias("_j"), F.col("depth").alias("_d"), F.col("total").alias("_s"), F.col("root").alias("_r"))
    both = open_.join(far, open_["tree"].eqNullSafe(far["_t"]) & (open_["jump"] == far["_n"]))
    return both.select("tree", "node", F.col("_j").alias("jump"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("total") + F.col("_s")).alias("total"), F.col("_r").alias("root"))


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """The messages of the ``top`` best root-to-leaf paths of each root.

    ``messages`` has tree, node (unique in its tree), parent (null: a root; one
    that the tree lacks makes its message a root), score, role and text.  Gives
    tree, leaf, rank, depth, role, text.  Paths rank by summed score, ties by
    the smaller leaf; null scores count as 0.  An empty table gives no paths.
    A cycle raises ValueError.
    """
    own = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    above = own.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    linked = own.join(above, own["tree"].eqNullSafe(above["_t"]) & (own["parent"] == above["_n"]), "left")
    jumps = linked.select("tree", "node", F.col("_n").alias("jump"), F.lit(1).alias("depth"), F.col("score").alias("total"), F.col("node").alias("root"))
    jumps = saved(jumps, "jumps")
    longest = jumps.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels, done = [], None  # done: messages whose pointer has passed the root, which no later round touches
    while True:
        past = jumps.filter("jump IS NULL")
        done = past if done is None else done.unionByName(past)
        open_ = jumps.filter("jump IS NOT NULL")
        if not open_.limit(1).count():
            break
        if 2 ** len(levels) > 2 * longest:
            raise ValueError("the reply graph has a cycle")
        levels.append(open_)
        jumps = saved(_next(open_, done.unionByName(open_)), "jumps")
    first = levels[0] if levels else done.limit(0)
    parents = first.select(F.col("tree").alias("_t"), F.col("jump").alias("_n"))
    leaves = done.join(parents, done["tree"].eqNullSafe(parents["_t"]) & (done["node"] == parents["_n"]), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree", "root").orderBy(F.col("total").desc(), "node"))
    members = leaves.select("tree", F.col("node").alias("leaf"), "node", rank.alias("rank")).filter(F.col("rank") <= top)
    for level in levels:
        step = level.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("jump").alias("_j"))
        up = members.join(step, members["tree"].eqNullSafe(step["_t"]) & (members["node"] == step["_n"])).select("tree", "leaf", F.col("_j").alias("node"), "rank")
        members = saved(members.unionByName(up), "paths")  # else the plan would double each time
    depths = done.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "depth")
    texts = messages.select(F.col("tree").alias("_mt"), F.col("node").alias("_mn"), "role", "text")
    members = members.join(depths, members["tree"].eqNullSafe(depths["_t"]) & (members["node"] == depths["_n"]))
    return members.join(texts, F.col("tree").eqNullSafe(F.col("_mt")) & (F.col("node") == F.col("_mn"))).select("tree", "leaf", "rank", "depth", "role", "text")


def render(path_rows: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each path: tree, leaf, rank, formatted, loss array<struct<start,length>> in code points.

    A path becomes one output string, so its turns meet in one task; paths are
    as long as the longest conversation and no longer.
    """
    turns = path_rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    piece = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(*learn).alias("learn"),
        ),
    )
    turns = turns.select("tree", "leaf", "rank", piece.alias("pieces"))
    formatted = F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))))
    start = F.struct(F.lit(1).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, length: INT>>)").alias("spans"))
    spans = F.aggregate(
        "pieces",
        start,
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + F.lit(len(CLOSE))).alias("at"),
            F.when(p["learn"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return turns.select("tree", "leaf", "rank", formatted.alias("formatted"), spans.alias("loss"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted string: array<struct<role,text>>, unescaped."""
    whole = F.split(formatted, CLOSE, -1)
    turns = F.slice(whole, F.lit(1), F.size(whole) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), "\n", 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(t, F.instr(t, "\n") + 1)).alias("text"),
        ),
    )


def learned(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """The best path of every conversation: conv_id, formatted, loss."""
    chosen = paths(linear_tree(turns), top=1)
    return render(chosen).select(F.col("tree").alias("conv_id"), "formatted", "loss")


def with_control(turns: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.range(1).select(
        F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t")
    )
    extra = extra.select(F.lit(-1).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(said).alias("text"))
    own = pick(turns, "conv_id", "turn", "role", "text")
    return own.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: counts, digests and lengths."""
    read = chats.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), learned(F.col("formatted"), F.col("loss")).alias("learned"))
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

