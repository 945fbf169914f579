"""Chat formatting of reply trees with DataFrame and Column operations only.

A tree's nodes carry parent links. Pointer doubling (each round joins the table of jumps with itself)
gives every node its depth and the score of its path in log2(depth) rounds, and a tree leaves the rounds
once they cover its size; leaves are ranked by that
score, and a second pass over the same rounds lists the nodes of each chosen path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.store import Table

START, END = "<|im_start|>", "<|im_end|>"
_TURN_END = END + "\n"


def escape(text: Column) -> Column:
    """Put one more backslash into every `<|`, `<\\|`, ...: afterwards no `<|` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chain_nodes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turn rows as a tree of one branch: each row replies to the row before it.

    Rows of equal turn are ordered by role, then text; repeated rows stay as turns of their own. Null
    turns come first; null roles and texts count as empty; rows of null conv_id form one conversation.
    """
    clean = turns.select(
        F.col(conv_id).alias("tree"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    node = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("bigint")
    numbered = clean.withColumn("node", node)
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _ended(rounds: list[DataFrame]) -> DataFrame:
    """Of each round the trees that need no further one: at most 2^k nodes in round k, all in the last."""
    out = rounds[-1]
    for k, df in enumerate(rounds[:-1]):
        out = out.unionByName(df.where(F.col("size") <= 2**k))
    return out


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Root-to-leaf paths of the `branches` best leaves of each tree.

    nodes: tree, node (unique within its tree), parent, role, text, score. A parent that does not exist
    makes its child a root; nodes on a cycle reach no root and belong to no path. A branch's score is the
    sum over its nodes (null: 0); ties go to the deeper leaf, then to the smaller node.
    Returns tree, leaf, rank, path_score, depth (0 at the root), role, text.
    """
    on = lambda left, right: F.col("tree").eqNullSafe(F.col("t2")) & (F.col(left) == F.col(right))
    base = Table(nodes.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")), "chat-nodes").df
    keys = base.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    sizes = base.groupBy(F.col("tree").alias("t3")).agg(F.count("*").alias("size"))
    links = base.select("tree", "node", "parent", "score").join(keys, on("parent", "n2"), "left").join(sizes, F.col("tree").eqNullSafe(F.col("t3")))
    # states[k] holds the trees of more than 2^(k-1) nodes, each node's jump being its ancestor 2^k above.
    states = [Table(links.select("tree", "node", F.col("n2").alias("jump"), F.col("n2").isNotNull().cast("bigint").alias("depth"), "score", "size"), "chat-round")]
    largest = states[0].df.agg(F.max("size")).first()[0] or 0
    while 2 ** (len(states) - 1) < largest:
        a = states[-1].df.where(F.col("size") > 2 ** (len(states) - 1))
        b = a.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("jump").alias("jump2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        state = a.join(b, on("jump", "n2"), "left").select(
            "tree",
            "node",
            F.col("jump2").alias("jump"),
            (F.col("depth") + F.coalesce(F.col("depth2"), F.lit(0))).alias("depth"),
            (F.col("score") + F.coalesce(F.col("score2"), F.lit(0.0))).alias("score"),
            "size",
        )
        states.append(Table(state, "chat-round"))
    ended = _ended([t.df for t in states])
    parents = states[0].df.where("jump is not null").select(F.col("tree").alias("t2"), F.col("jump").alias("n2")).distinct()
    rooted = ended.where("jump is null")
    leaves = rooted.join(parents, on("node", "n2"), "left_anti")
    order = W.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    paths = [Table(chosen.select("tree", F.col("node").alias("leaf"), "rank", F.col("score").alias("path_score"), "node", "size"), "chat-paths").df]
    for k, jumps in enumerate(states[:-1]):
        up = jumps.df.where((F.col("size") > 2**k) & F.col("jump").isNotNull()).select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "jump")
        now = paths[-1].where(F.col("size") > 2**k)
        above = now.join(up, on("node", "n2")).select("tree", "leaf", "rank", "path_score", F.col("jump").alias("node"), "size")
        paths.append(Table(now.unionByName(above), "chat-paths").df)
    paths = _ended(paths)
    depths = rooted.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "depth")
    text = base.select("tree", "node", "role", "text").join(depths, on("node", "n2")).select("t2", "n2", "depth", "role", "text")
    full = paths.join(text, on("node", "n2"))
    return full.select("tree", "leaf", "rank", "path_score", "depth", "role", "text")


def format_paths(paths: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per path: tree, leaf, rank, path_score, formatted, loss_spans (code points, end exclusive).

    Turns read `<|im_start|>role\\ntext<|im_end|>\\n`; the loss mask covers the texts of the roles in `learn`.
    """
    turn = F.struct("depth", _escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), F.col("role").isin(*learn).alias("learn"))
    grouped = paths.groupBy("tree", "leaf", "rank", "path_score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(_TURN_END)))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, t):
        start = acc["at"] + len(START) + F.length(t["role"]) + 1
        end = start + F.length(t["text"])
        one = F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        spans = F.when(t["learn"], F.concat(acc["spans"], one)).otherwise(acc["spans"])
        return F.struct((end + len(_TURN_END)).cast("bigint").alias("at"), spans.alias("spans"))

    spans = F.aggregate("turns", zero, step, lambda acc: acc["spans"])
    return grouped.select("tree", "leaf", "rank", "path_score", F.array_join(parts, "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add turns: array<struct<role, text>> and loss_text, both read from `formatted` and `loss_spans` alone."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x)))

    def turn(x):
        cut = F.locate("\n", x)
        return F.struct(
            _unescape_role(F.substring(x, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(x, cut + 1, F.length(x))).alias("text")
        )

    def under(s):
        return unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    return formatted.withColumn("turns", F.transform(bodies, turn)).withColumn("loss_text", F.array_join(F.transform("loss_spans", under), ""))


def chat_digest(turns: DataFrame) -> DataFrame:
    """Format every conversation as its best path and digest what is read back from the output."""
    back = read_back(format_paths(reply_paths(chain_nodes(turns))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
