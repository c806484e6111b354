"""Chat formatting of reply trees, in DataFrame operations only.

Messages point at their parents. Self-joins double the distance that each
message's ancestor link spans, so a path of any length is enumerated in as
many rounds as its length has binary digits. Leaves are ranked by the score
of their branch; each chosen branch becomes one conversation.

Template: ``<|im_start|>role NEWLINE text<|im_end|>NEWLINE`` per turn. Inside
texts and roles a backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a
newline also becomes ``<\\n``), so no control string can come from content and
everything reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: a ``<`` before exactly one backslash and ``|`` can only be an escape."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` root-to-leaf paths of each tree.

    In: ``tree``, ``node``, ``parent`` (null or unknown: a root), ``score``
    (null: 0). Out, one row per message of a chosen path: tree, leaf, rank
    (from 1), node, up (0 at the leaf). Branches rank by the sum of their
    scores, ties by leaf. Of rows that repeat a node that with the smallest
    parent, then score, counts. Messages without tree or node are left out,
    and so are those on a cycle of parents, which hang on no root. Extra
    columns are ignored; an empty table gives an empty table.
    """
    scored = messages.filter("tree is not null and node is not null").select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    messages = scored.groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("m")).select("tree", "node", "m.*")
    real = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    base = messages.join(real, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("anc"), "score")
    base = materialize(base, "chat-messages")
    n = base.count()
    # level k: the messages with an ancestor 2^k up, that ancestor, and the score of the 2^k messages from each on
    lifts = [base.filter("anc is not null")]
    while 2 ** (len(lifts) - 1) < n and not lifts[-1].isEmpty():
        low = lifts[-1]
        top = low.select("tree", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("score").alias("score2"))
        lifts.append(materialize(low.join(top, ["tree", "anc"]).select("tree", "node", F.col("anc2").alias("anc"), (F.col("score") + F.col("score2")).alias("score")), "chat-lift"))
    parents = lifts[0].select("tree", F.col("anc").alias("node")).distinct()
    leaves = base.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("total"))
    # leaves only: climb by the largest spans first and add up the scores passed
    for k, lift in reversed(list(enumerate(lifts))):
        leaves = leaves.join(lift, ["tree", "node"], "left").select("tree", "leaf", F.coalesce("anc", "node").alias("node"), (F.col("total") + F.when(F.col("anc").isNotNull(), F.col("score")).otherwise(0.0)).alias("total"))
        if k % 3 == 2:
            leaves = materialize(leaves, "chat-leaves")
    roots = base.filter("anc is null").select("tree", "node", "score")  # a climb that ends elsewhere came to a cycle
    scored = leaves.join(roots, ["tree", "node"]).select("tree", F.col("leaf").alias("node"), (F.col("total") + F.col("score")).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))).filter(F.col("rank") <= best)
    path = materialize(ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("up")), "chat-path")
    for k, lift in enumerate(lifts):
        above = path.join(lift.select("tree", "node", "anc"), ["tree", "node"])
        path = path.unionByName(above.select("tree", "leaf", "rank", F.col("anc").alias("node"), (F.col("up") + 2**k).alias("up")))
        if k % 3 == 2:
            path = materialize(path, "chat-path")
    return path


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One formatted conversation for each (tree, leaf).

    In: tree, leaf, position, role, text (null: empty). Out: tree, leaf,
    formatted, and loss_spans, the (start, length) in code points, from 1, of
    each text that the loss counts. One conversation is one string, so its
    turns meet in one row. Null roles count as empty, null trees form one
    group, turns that share a position stand in the order of their text.
    Extra columns are ignored; an empty table gives an empty table.
    """
    order = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    pieces = turns.select("tree", "leaf", "position", "role", head.alias("head"), body.alias("body")).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    pieces = pieces.withColumn("before", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)))
    span = F.when(F.col("role") == loss_role, F.struct((F.col("before") + F.length("head") + 1).alias("start"), F.length("body").cast("long").alias("length")))
    grouped = pieces.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("position", "piece", span.alias("span")))).alias("turns"))
    return grouped.select(
        "tree", "leaf",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2_000_000_000)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring_index(F.substr(p, F.position(F.lit("\n"), p) + 1), END, 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span, joined with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """tree (conv_id), formatted and loss_spans for chains of turns.

    In: conv_id, turn, role, text. Turns reply to the turn before them in the
    order of turn (null first), role, text; repeated rows are turns of their
    own. Null roles and texts count as empty; rows with a null conv_id form
    one conversation, apart from that of an empty id. Extra columns are ignored; an empty table gives an
    empty table.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = materialize(conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).alias("node"), "role", "text"), "chat-turns")
    # joins on the tree need a value where the id is null: every id gets a sign in front, none has none
    keyed = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")))
    replies = keyed.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(None).cast("double").alias("score"))
    paths = branches(replies).select("tree", "leaf", "node", (-F.col("up")).alias("position"))
    turns = paths.join(keyed, ["tree", "node"])
    kind = conversations.schema["conv_id"].dataType
    return format_turns(turns).withColumn("tree", F.when(F.col("tree") != "", F.substring("tree", 2, 2_000_000_000)).cast(kind))
