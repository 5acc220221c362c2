"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by parent. Ancestors are found by self-joins that double their reach (1, 2, 4, ... replies), so a
path of length L takes log2(L) joins instead of L. Each leaf has a branch score, the sum of the scores from its root; the
best `top_k` leaves of a tree (ties: smallest leaf id) become conversations. Only narrow id rows are joined; texts meet
their path once, at the end.

Template: a turn is `<|im_start|>role`, a newline, the text, `<|im_end|>` and a newline. In texts and roles a backslash is
doubled and `<|` becomes `<\\|`, hence no control string is left in them and reading back is exact.

Defined cases: a null or empty text is an empty turn, a null role an empty one, a null score 0. A message whose parent is null or does not exist is
a root. Messages that only lead round in a circle have no root and raise an error, as no path can hold them. Message ids are
unique within a tree (repeated rows get ids of their own from `linear_messages`). A null tree id is a tree of its own. An empty table gives no
conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seqpulse.llm.common import store

# The turn marks of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|nl|>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|nl|>"), F.lit("\n")))


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as trees of one branch: each row replies to the one before it, by (turn, role, text)."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("message_id", F.row_number().over(order).cast("long"))
    return rows.select(
        F.col("conv_id").alias("tree_id"), "message_id",
        F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """Columns tree, branch (rank of the leaf), message_id, depth (0 at the leaf): the paths of the best leaves of each tree."""
    tree = F.coalesce(F.concat(F.lit("t"), F.col("tree_id").cast("string")), F.lit("")).alias("tree")  # "": the null tree
    ids = store(messages.select(tree, "message_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "chat-ids")
    parents = ids.select("tree", F.col("message_id").alias("parent_id")).distinct()
    hop = ids.join(parents.withColumn("there", F.lit(True)), ["tree", "parent_id"], "left").select(
        "tree", "message_id", F.when(F.col("there"), F.col("parent_id")).alias("up"), "score")
    hop = store(hop, "chat-hop")
    hops = [hop]
    limit = max(1, ids.count()).bit_length() + 1
    while hop.filter(F.col("up").isNotNull()).limit(1).count():
        if len(hops) > limit:
            raise ValueError("messages reply to each other in a circle")
        above = hop.select("tree", F.col("message_id").alias("up"), F.col("up").alias("up2"), F.col("score").alias("more"))
        hop = hop.join(above, ["tree", "up"], "left").select(
            "tree", "message_id", F.col("up2").alias("up"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
        hop = store(hop, "chat-hop")
        hops.append(hop)
    replied = ids.filter(F.col("parent_id").isNotNull()).select("tree", F.col("parent_id").alias("message_id")).distinct()
    leaves = hop.join(replied, ["tree", "message_id"], "left_anti")  # the last hop holds the sums from the root
    best = W.partitionBy("tree").orderBy(F.col("score").desc(), "message_id")
    path = leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= top_k).select(
        "tree", "branch", "message_id", F.lit(0).cast("long").alias("depth"))
    for k, reach in enumerate(hops):
        steps = reach.filter(F.col("up").isNotNull()).select("tree", "message_id", "up")
        path = store(path.union(path.join(steps, ["tree", "message_id"]).select(
            "tree", "branch", F.col("up").alias("message_id"), (F.col("depth") + (1 << k)).alias("depth"))), "chat-path")
    return path


def format_chats(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """Columns tree_id, branch, formatted, loss_spans (array of first character and length, of the assistant's texts)."""
    tree = F.coalesce(F.concat(F.lit("t"), F.col("tree_id").cast("string")), F.lit(""))
    turns = chosen_paths(messages, top_k).join(messages.withColumn("tree", tree), ["tree", "message_id"]).select(
        "tree", "branch", "tree_id", "depth", F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + len(END) + 1)
    before = W.partitionBy("tree", "branch").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    grouped = turns.groupBy("tree", "branch").agg(
        F.first("tree_id").alias("tree_id"),
        F.array_sort(F.collect_list(F.struct("start", F.concat("head", "body", F.lit(END + "\n")).alias("turn")))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("loss"), F.struct("start", F.length("body").alias("length"))))).alias("loss_spans"))
    return grouped.select("tree_id", "branch", F.array_join("turns.turn", "").alias("formatted"), "loss_spans")


def read_chats(chats: DataFrame) -> DataFrame:
    """The way back: tree_id, branch, turns (array of role and text), loss_text, formatted_chars."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda _, i: i > 0)

    def turn(block):
        at = F.instr(block, "\n")  # 1-based: the end of the role
        body = F.substring(block, at + 1, F.length(block) - at - (len(END) + 1))
        return F.struct(_unescape_role(F.substring(block, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"])))
    return chats.select(
        "tree_id", "branch", F.transform(blocks, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"))
