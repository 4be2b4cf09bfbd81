"""Chat formatting of reply trees, in DataFrame functions only.

Root-to-leaf paths come from self-joins that double: every node points to an
ancestor, with the number of nodes and the sum of scores up to it, and each
round joins it with that ancestor's own pointer, so a tree of depth d takes
log2(d) rounds of one row per node.  Branches are ranked by the sum of their
scores (ties: smaller leaf).  The nodes of the chosen ones are found through the
pointers of all rounds, from the longest: each doubles what is known of a path.
Each chosen path becomes one conversation.

Template: `<|turn|>` role `<|says|>` text `<|end|>` and a line end per turn.
Inside roles and texts every backslash, `<` and `[` is written as `\\0`, `\\1`
or `\\2`, so no control string, of this template or of others that start with
these signs, can stand in a conversation; the reverse replacements, in reverse
order, give the text back exactly.  `loss_spans` are the code points of the
assistant's texts.

Defined results: null texts and roles are empty; a parent that is missing makes
its child a root; nodes on a cycle of parents have no path from a root and form
no branch; equal scores go by leaf; nodes that repeat an id within a tree are
one (the row that sorts first); null trees form one tree; a very long
text or chain of turns is one conversation all the same; an empty table gives an
empty table.  Other input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.staging import Stage

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
_CODES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2")]


def escape(c: Column) -> Column:
    for raw, code in _CODES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(_CODES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def _same(a: str, b: str, c: str, d: str) -> Column:
    """Equal trees (null is one of them) and equal nodes."""
    return F.col(a).eqNullSafe(F.col(b)) & (F.col(c) == F.col(d))


def branches(nodes: DataFrame, stage: Stage) -> tuple[DataFrame, list[DataFrame]]:
    """nodes: tree, node, parent, score.  The root-to-leaf paths as tree, leaf, nodes (their number), score and rank; and pointers.

    The k-th table of pointers has tree, node and the ancestor 2^k steps up, for the nodes that have one.
    """
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    start = nodes.join(known, _same("tree", "t", "parent", "n"), "left")
    start = start.select("tree", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("nodes"), F.coalesce("score", F.lit(0.0)).alias("score"))
    now, pointers = stage.table(start, "up-0"), []
    most = now.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while len(pointers) <= most.bit_length() and now.where("up IS NOT NULL").limit(1).count():
        pointers.append(now.where("up IS NOT NULL").select("tree", "node", "up"))
        a, b = now.where("up IS NOT NULL").alias("a"), now.alias("b")  # finished paths are not joined again
        grown = a.join(b, _same("a.tree", "b.tree", "a.up", "b.node"))
        grown = grown.select("a.tree", "a.node", "b.up", (F.col("a.nodes") + F.col("b.nodes")).alias("nodes"), (F.col("a.score") + F.col("b.score")).alias("score"))
        now = stage.table(now.where("up IS NULL").unionByName(grown), f"up-{len(pointers)}")
    parents = nodes.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = now.where("up IS NULL").join(parents, _same("tree", "t", "node", "p"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    return leaves.select("tree", F.col("node").alias("leaf"), "nodes", "score", rank.alias("rank")), pointers


def path_nodes(chosen: DataFrame, pointers: list[DataFrame], stage: Stage) -> DataFrame:
    """chosen: tree, leaf, nodes, more columns.  A row per node of each path, with its place from 0: every ancestor comes once."""
    more = [c for c in chosen.columns if c not in ("tree", "leaf", "nodes")]
    steps = stage.table(chosen.select("tree", "leaf", F.col("leaf").alias("node"), (F.col("nodes") - 1).alias("pos"), *more), "path-all")
    for k in range(len(pointers) - 1, -1, -1):
        up = pointers[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        above = steps.join(up, _same("tree", "t", "node", "n")).select("tree", "leaf", F.col("up").alias("node"), (F.col("pos") - (1 << k)).alias("pos"), *more)
        steps = stage.table(steps.unionByName(above), f"path-{k}")
        stage.drop(f"path-{k + 1}" if k + 1 < len(pointers) else "path-all")
    return steps


def format_reply_trees(messages: DataFrame, stage: Stage, best: int | None = 1, trained_role: str = "assistant") -> DataFrame:
    """messages: tree, node, parent, role, text, score.

    A row per chosen path: tree, leaf, rank, score, formatted, loss_spans (array of start and length in code points).
    """
    first = Window.partitionBy("tree", "node").orderBy("parent", "role", "text")
    messages = messages.withColumn("copy", F.row_number().over(first)).where("copy = 1 AND node IS NOT NULL").drop("copy")
    messages = stage.table(messages.select("tree", "node", "parent", "role", "text", F.col("score").cast("double").alias("score")), "messages")
    paths, pointers = branches(messages.select("tree", "node", "parent", "score"), stage)
    if best is not None:
        paths = paths.where(F.col("rank") <= best)
    steps = path_nodes(paths.withColumnRenamed("score", "branch_score"), pointers, stage)
    text = escape(F.coalesce("text", F.lit("")))
    role = escape(F.coalesce("role", F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit(SAYS))
    m = messages.select(F.col("tree").alias("mtree"), F.col("node").alias("mnode"), head.alias("head"), text.alias("body"), (F.col("role") == trained_role).alias("trained"))
    rows = steps.join(m, _same("tree", "mtree", "node", "mnode"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.sum(size).over(Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head"))
    turn = F.struct(
        "pos", F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(F.col("trained"), F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"))).alias("span")
    )
    made = rows.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("branch_score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return made.select("tree", "leaf", "rank", "score", F.array_join(F.col("turns.piece"), "").alias("formatted"), F.array_compact(F.col("turns.span")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text."""
    parts = F.slice(F.split(formatted, "<\\|turn\\|>"), 2, 1 << 30)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, SAYS, 1)
        at = F.length(role) + len(SAYS) + 1
        return F.struct(unescape(role).alias("role"), unescape(F.substring(p, at, F.length(p) - at + 1 - len(END))).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op2_chat_format(spark, sf_dir):
    """All conversations and conversation -1; rows of the table that have the id -1 themselves belong to it as well."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -1L AS conv_id, stack(2, 0L, 'user', '</s>[INST] ok [/INST]', 1L, 'assistant', '</s>[INST] ok [/INST]') AS (turn, role, text)")
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    messages = said.unionByName(extra).select(
        F.col("conv_id").alias("tree"), node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
    out = format_reply_trees(messages, Stage(spark, "op2"))
    turns = read_turns(F.col("formatted"))
    out = out.select(
        F.col("tree").alias("conv_id"), turns.alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars")
    )
    said_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


OP2_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM said
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text)
    + 2 * (length(role) + length(text)) - length(replace(role, '\', '')) - length(replace(text, '\', ''))
    - length(replace(replace(role, '<', ''), '[', '')) - length(replace(replace(text, '<', ''), '[', ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
