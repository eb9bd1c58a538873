"""Chat formatting of reply trees, with DataFrame functions only.

A node replies to its parent.  Iterative self-joins double the distance they reach: after
``i`` rounds every node knows the ancestor ``2^i`` steps up and what lies between, so trees
of depth ``d`` take ``log2(d)`` joins of slim rows.  The sums met on the way are a path's
number of turns, its score and the place of every turn in the formatted text.  Branches
(leaves) are ranked by the mean score of their path, the longer path first among ties, then
the smaller leaf id; the same ancestor tables, read from the longest step to the shortest,
enumerate every turn of the chosen paths exactly once, and texts are joined at the end.

A turn reads ``<turn>ROLE<text>TEXT</turn>\\n``.  In roles and texts ``\\`` is doubled and
each of ``<turn>``, ``<text>``, ``</turn>`` gets a ``\\`` after its ``<``, so marks inside
texts never count and ``unescaped`` gives every text back.  The loss mask holds one entry a
turn: where the turn starts, and the code points of it under the loss (assistant texts;
null for others).

Defined results: null texts, roles and scores (also NaN) are empty, empty and 0; a null
tree id is a tree; a node without parent, or whose parent is not there, is a root; of
nodes with one id the best scored one (then by hash of its content) gets the replies, the
others are leaves; nodes with null ids have no replies; a node on or under a circle has no
path from a root and is in no conversation; an empty table gives an empty one.  A path's
turns meet in one row, since that row is the conversation; nothing else gathers a tree.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantlake.llm.common import stored
from variantlake.operators.ranking import group_index, top_n_per_group

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
NEWLINE = "\n"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (TURN, TEXT, END):
        out = F.replace(out, F.lit(mark), F.lit(f"<\\{mark[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    """Exact inverse: an escaped mark has one ``\\`` after its ``<``, all others come in pairs."""
    for mark in (TURN, TEXT, END):
        text = F.replace(text, F.lit(f"<\\{mark[1:]}"), F.lit(mark))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def from_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as trees of one branch: every row replies to the row before it by
    (turn, role, text), nulls first."""
    rows = turns.select(F.col(conv_col).alias("tree_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = group_index(rows, ["tree_id"], ["turn", "role", "text"], out="node_id")
    return rows.select("tree_id", "node_id", F.when(F.col("node_id") > 0, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _linked(nodes: DataFrame) -> DataFrame:
    """Slim rows: (rid, anc: the parent's rid or null, hops, score, chars, ids of tree and node)."""
    slim = nodes.select("rid", "tree", "node", "parent", "score", F.char_length("piece").cast("long").alias("chars"),
                        F.xxhash64("role", "piece").alias("tie"))
    first = (slim.where(F.col("node").isNotNull()).groupBy("tree", "node")
             .agg(F.min(F.struct(-F.col("score"), "tie", "rid")).alias("first"))
             .select(F.col("tree").alias("p_tree"), F.col("node").alias("p_node"), F.col("first.rid").alias("anc")))
    replies = slim.where(F.col("parent").isNotNull()).join(
        first, F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("parent") == F.col("p_node")), "left")
    roots = slim.where(F.col("parent").isNull()).withColumn("anc", F.lit(None).cast("long"))
    cols = ["rid", "anc", F.lit(1).cast("long").alias("hops"), "score", "chars", "tree", "node", "tie"]
    return replies.select(*cols).unionByName(roots.select(*cols))


def _doubled(links: DataFrame) -> list[DataFrame]:
    """Tables 0, 1, ...: in table ``i`` a row's ``anc`` is ``2^i`` steps up, or null when its
    sums reach the root.  The last one has no ``anc`` left but those of circles."""
    tables = [stored(links, "replies-0")]
    n, step = tables[0].count(), 1
    while step <= n and not (open_rows := tables[-1].where(F.col("anc").isNotNull())).isEmpty():
        up = tables[-1].select(F.col("rid").alias("anc"), F.col("anc").alias("u_anc"), F.col("hops").alias("u_hops"), F.col("score").alias("u_score"), F.col("chars").alias("u_chars"))
        further = open_rows.join(up, "anc").select(
            "rid", F.col("u_anc").alias("anc"), (F.col("hops") + F.col("u_hops")).alias("hops"),
            (F.col("score") + F.col("u_score")).alias("score"), (F.col("chars") + F.col("u_chars")).alias("chars"), "tree", "node", "tie")
        tables.append(stored(tables[-1].where(F.col("anc").isNull()).unionByName(further), f"replies-{len(tables)}"))
        step *= 2
    return tables


def _turns_of(chosen: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(leaf, rid, back): every turn of the chosen paths, ``back`` steps above its leaf."""
    rows = chosen.withColumns({"rid": F.col("leaf"), "back": F.lit(0).cast("long")})
    for i in reversed(range(len(tables) - 1)):
        step = 1 << i
        here = F.col("back") + step < F.col("hops")
        up = tables[i].where(F.col("anc").isNotNull()).select(F.col("rid").alias("u_rid"), F.col("anc").alias("u_anc"))
        rows = (
            rows.withColumn("key", F.when(here, F.col("rid")).otherwise(-1 - F.col("leaf")))  # no row has a negative rid
            .join(up, F.col("key") == F.col("u_rid"), "left")
            .select(*chosen.columns, F.explode(F.filter(F.array(
                F.struct("rid", "back"),
                F.when(F.col("u_anc").isNotNull(), F.struct(F.col("u_anc").alias("rid"), (F.col("back") + step).alias("back")))),
                lambda x: x.isNotNull())).alias("at"))
            .select(*chosen.columns, "at.rid", "at.back"))
    return rows


def format_paths(nodes: DataFrame, *, best: int | None = 1, tree_col: str = "tree_id", node_col: str = "node_id", parent_col: str = "parent_id",
                 role_col: str = "role", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The ``best`` branches of every tree (None: all), one conversation a row: ``tree_id,
    leaf_id, path_rank, n_turns, path_score, formatted, mask``; ``mask`` has ``(start,
    loss_start, loss_end)`` of every turn in code points of ``formatted``, end exclusive."""
    col = lambda c: F.col(f"`{c}`")
    score = F.coalesce(F.nanvl(col(score_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    role, text = escaped(F.coalesce(col(role_col), F.lit(""))), escaped(F.coalesce(col(text_col), F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    base = stored(nodes.select(
        col(tree_col).alias("tree"), col(node_col).alias("node"), col(parent_col).alias("parent"), col(role_col).alias("role"),
        score.alias("score"), F.char_length(head).alias("head"), F.concat(head, text, F.lit(END + NEWLINE)).alias("piece"),
        F.monotonically_increasing_id().alias("rid")), "reply-nodes")
    tables = _doubled(_linked(base))
    rooted = tables[-1].where(F.col("anc").isNull())
    replied = tables[0].where(F.col("anc").isNotNull()).select(F.col("anc").alias("rid")).distinct()
    leaves = rooted.join(replied, "rid", "left_anti").select(
        F.col("rid").alias("leaf"), "tree", F.col("node").alias("leaf_node"), "hops", (F.col("score") / F.col("hops")).alias("path_score"), "tie")
    order = [F.col("path_score").desc(), F.col("hops").desc(), F.col("leaf_node"), F.col("tie"), F.col("leaf")]
    if best is None:
        chosen = group_index(leaves, ["tree"], order, out="path_rank").withColumn("path_rank", (F.col("path_rank") + 1).cast("int"))
    else:
        chosen = top_n_per_group(leaves, ["tree"], order, best, out="path_rank")
    turns = _turns_of(chosen.drop("tie"), tables)
    ends = rooted.select("rid", F.col("chars").alias("end"))
    placed = turns.join(ends, "rid").join(base.select("rid", "role", "head", "piece"), "rid")
    start = F.col("end") - F.char_length("piece")
    lost = F.col("role") == "assistant"
    turn = F.struct((-F.col("back")).alias("at"), "piece", F.struct(
        start.alias("start"), F.when(lost, start + F.col("head")).alias("loss_start"),
        F.when(lost, F.col("end") - len(END + NEWLINE)).alias("loss_end")).alias("mask"))
    path = placed.groupBy("leaf", "tree", "leaf_node", "path_rank", "hops", "path_score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return path.select(
        F.col("tree").alias("tree_id"), F.col("leaf_node").alias("leaf_id"), "path_rank", F.col("hops").alias("n_turns"), "path_score",
        F.array_join(F.col("turns.piece"), "").alias("formatted"), F.col("turns.mask").alias("mask"))


def read_back(paths: DataFrame) -> DataFrame:
    """``paths`` with what their formatted texts and masks say: ``turns`` (role, text) and
    ``loss_text``, the unescaped text under the mask."""
    said = lambda p: F.struct(
        unescaped(F.substring(F.substring_index(p, TEXT, 1), len(TURN) + 1, 2**31 - 1)).alias("role"), unescaped(F.substring_index(p, TEXT, -1)).alias("text"))
    under = lambda p, m: unescaped(p.substr((m["loss_start"] - m["start"] + 1).cast("int"), (m["loss_end"] - m["loss_start"]).cast("int")))
    pieces = paths.withColumn("_pieces", F.filter(F.split("formatted", END + NEWLINE), lambda p: p != ""))
    return pieces.withColumns({
        "turns": F.transform("_pieces", said), "loss_text": F.array_join(F.zip_with("_pieces", "mask", under), "")}).drop("_pieces")
