"""Root and depth of every node of a parent-pointer forest.

Pointer jumping: each round replaces a node's ancestor pointer by the
ancestor's own pointer and adds the depths, so the number of rounds is
log2(max depth), each round one shuffle join over the node table. Every round
is written with ``checkpoint()`` into the session's shared checkpoint directory,
so a lost executor re-reads it instead of replaying earlier rounds, and the
test whether rows are left does not compute the round again. Rounds go on until
every node is done; a parent cycle, whose nodes never are, is an error: with n
nodes no chain is longer than n, so after log2(n) + 1 rounds what is left is one.

``tree`` doubles exactly: after k rounds a node knows its 2^k-th ancestor, the last
2^k nodes of its path, and the sums over its descendants less than 2^k below. A round
puts the ancestor's path before the node's own, and adds to each node the sums of those
whose 2^k-th ancestor it is (combined map-side: a root with a third of all nodes is one
row for each task). A node that stands in its own path is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, root_<id>, depth) — depth 0 for roots."""
    from agentlake.session import checkpoint_dir
    checkpoint_dir(nodes.sparkSession)
    cur = nodes.select(F.col(id_col).alias("node"), F.col(parent_col).alias("anc"),
                       F.when(F.col(parent_col).isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
                       F.col(parent_col).isNull().alias("done"))
    cur = cur.checkpoint(eager=True)
    rounds_left = max(1, cur.count()).bit_length() + 1
    while cur.filter(~F.col("done")).limit(1).count():
        if not rounds_left:
            raise ValueError(f"{parent_col} has a cycle: some nodes reach no root")
        rounds_left -= 1
        nxt = cur.select(F.col("node").alias("_n"), F.col("anc").alias("_a"),
                         F.col("depth").alias("_d"), F.col("done").alias("_done"))
        j = cur.join(nxt, cur["anc"] == nxt["_n"], "left")
        # an ancestor that is itself finished (root reached) ends the walk
        cur = j.select(
            "node",
            F.when(F.col("done"), F.col("anc")).when(F.col("_a").isNull(), F.col("anc"))
             .otherwise(F.col("_a")).alias("anc"),
            F.when(F.col("done") | F.col("_n").isNull(), F.col("depth"))
             .otherwise(F.col("depth") + F.col("_d")).alias("depth"),
            (F.col("done") | F.col("_n").isNull() | F.col("_a").isNull() | F.col("_done")).alias("done"),
        ).checkpoint(eager=True)
    root = F.coalesce(F.col("anc"), F.col("node"))
    return cur.select(F.col("node").alias(id_col), root.alias(f"root_{id_col}"), "depth")


def tree(nodes: DataFrame, id_col: str, parent_col: str, values: list[str]) -> DataFrame:
    """id, root_<id>, depth, path (array from the root to the node), subtree_nodes and, for
    each of ``values``, subtree_<value>: its sum over the node and all below it. A parent that
    is no node itself is the root of its children, with no row of its own."""
    from agentlake.session import written
    sums = ["nodes", *values]
    cur = nodes.select(F.col(id_col).alias("node"), F.col(parent_col).alias("up"), F.array(id_col).alias("path"), F.lit(1).cast("long").alias("nodes"), *values)
    known = cur.select(F.col("node").alias("up"), F.lit(True).alias("is_node"))
    # a parent without a row begins the path of its children and takes no sums
    cur = written(cur.join(known, "up", "left").select(
        "node", F.when(F.col("is_node"), F.col("up")).alias("up"),
        F.when(F.col("is_node") | F.col("up").isNull(), F.col("path")).otherwise(F.concat(F.array("up"), "path")).alias("path"), *sums), "tree")
    types = dict(cur.dtypes)
    while cur.filter(F.col("up").isNotNull()).limit(1).count():
        if cur.filter(F.array_position("path", F.col("node")) < F.size("path")).limit(1).count():
            raise ValueError(f"{parent_col} has a cycle: some nodes stand above themselves")
        above = cur.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        below = cur.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        cur = written(cur.join(above, "up", "left").join(below, "node", "left").select(
            "node", F.col("_up").alias("up"), F.when(F.col("_path").isNotNull(), F.concat("_path", "path")).otherwise(F.col("path")).alias("path"),
            *[F.coalesce((F.col(c) + F.col(f"_{c}")).cast(types[c]), F.col(c)).alias(c) for c in sums]), "tree")
    return cur.select(F.col("node").alias(id_col), F.col("path")[0].alias(f"root_{id_col}"), (F.size("path") - 1).cast("bigint").alias("depth"), "path",
                      *[F.col(c).alias(f"subtree_{c}") for c in sums])
