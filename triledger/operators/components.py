"""Connected components of tickets by alternating large-star and small-star rounds.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triledger.operators.durable import durable, fingerprint, known_rows
from triledger.operators.skew import hot_buckets, hot_keys, hot_limit, salted_join, salts_for


def _with_minimum(pairs: DataFrame, node: str, other: str, hot_rows: int | None) -> DataFrame:
    """Add the smallest neighbour `m` of each node to its pairs; busy nodes are dealt over salts."""
    if hot_rows is None:
        # No node is busy, so a node's pairs fit one window.
        return pairs.withColumn("m", F.min(other).over(Window.partitionBy(node)))
    minima = pairs.groupBy(node).agg(F.min(other).alias("m"), F.count("*").alias("degree"))
    # At most pairs / hot_rows nodes are that busy; each gets the salts that its degree asks for.
    busy = F.broadcast(minima.filter(F.col("degree") > hot_rows).select(node, salts_for(F.col("degree"), hot_rows).alias("_salts")))
    dealt = F.pmod(F.xxhash64(other), F.col("_salts").cast("bigint"))
    left = pairs.join(busy, node, "left").withColumn("_salt", F.coalesce(dealt, F.lit(0).cast("bigint"))).drop("_salts")
    salts = F.when(F.col("degree") > hot_rows, salts_for(F.col("degree"), hot_rows)).otherwise(1)
    right = minima.select(node, "m", F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint"))).alias("_salt"))
    return left.join(right, [node, "_salt"]).drop("_salt")


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _busy_from(edges: DataFrame, hot_rows: int) -> int | None:
    """The number of neighbours from which a node is busy; none where no node is.

    A round gives no node more larger or more smaller neighbours than it had neighbours of both kinds.
    """
    ends = 2 * known_rows(edges)
    if ends <= hot_rows:
        return None
    limit = hot_limit(hot_rows, ends)
    busy = hot_buckets(_both(edges), ["u"], limit, ends)
    if busy is None:
        busy = durable(hot_keys(_both(edges), ["u"], limit))
    return limit if known_rows(busy) else None


def _stars(edges: DataFrame) -> DataFrame:
    """The edges, distinct and from larger to smaller nodes, with a flag for those of whole components around their smallest node.

    That is where every neighbour of the smaller node is larger and has no other neighbour.
    """
    at = Window.partitionBy("_node")
    ends = edges.select(F.col("u").alias("_node"), "v").unionByName(edges.select(F.col("v").alias("_node"), F.lit(None).cast(edges.schema["v"].dataType).alias("v")))
    seen = ends.withColumns({"_degree": F.count("*").over(at), "_smaller": F.count("v").over(at)})
    upward = F.col("v").isNotNull()
    # A node tells its smaller neighbours whether it has others; one that has smaller neighbours tells itself that it is no centre.
    told = seen.filter(upward | (F.col("_smaller") > 0)).select(
        F.when(upward, F.col("_node")).alias("u"), F.coalesce("v", "_node").alias("v"), (upward & (F.col("_degree") == 1)).alias("_leaf"))
    return told.withColumn("_star", F.min("_leaf").over(Window.partitionBy("v"))).filter(F.col("u").isNotNull()).select("u", "v", "_star")


def _large_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node in its neighbourhood."""
    both = _both(edges)
    starred = _with_minimum(both, "u", "v", hot_rows).filter(F.col("v") > F.col("u"))
    return starred.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    """Link the smaller neighbours of a node, and the node itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_minimum(down, "u", "v", hot_rows)
    return (
        starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(starred.select("u", F.col("m").alias("v")))
        .filter(F.col("u") != F.col("v")).distinct()
    )


def connected_components(edges: DataFrame, *, hot_rows: int = 1_000_000) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the smallest node of its component.

    `edges` has the columns u and v; direction, repetition and loops do not matter.
    """
    # Sums of hashes as whole numbers of any size, so the checksum cannot overflow.
    content = F.xxhash64("u", "v").cast("decimal(38,0)")
    state = durable(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), content)
    done = None
    if known_rows(state) > 0 and _busy_from(state, hot_rows) is None:
        # Most tickets have one partner: whole components leave before the rounds, which move every edge that is left.
        marked = durable(_stars(state))
        done, state = marked.filter("_star").drop("_star"), durable(marked.filter("not _star").drop("_star"), content)
    # Every round at least shortens all paths, so the rounds end by themselves: about the logarithm of the longest path.
    while known_rows(state) > 0:
        hot = _busy_from(state, hot_rows)
        before, state = state, durable(_small_star(_large_star(state, hot), hot), content)
        if fingerprint(before) == fingerprint(state):
            break
    state = state if done is None else done.unionByName(state)
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def node(agent, ticket):
    return F.concat_ws("|", agent, ticket)


def ticket_edges(*sources: DataFrame) -> DataFrame:
    """Star edges between the first and every further ticket of a row, within its agent."""
    parts = [
        rows.filter(F.size("tickets") > 1).select(
            "agent", F.get("tickets", F.lit(0)).alias("t0"),
            F.explode(F.slice("tickets", 2, F.size("tickets") - 1)).alias("t"))
        for rows in sources
    ]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return edges.select(node("agent", "t0").alias("u"), node("agent", "t").alias("v")).distinct()


def with_group(rows: DataFrame, components: DataFrame, hot_rows: int) -> DataFrame:
    """Add `gid` (agent|smallest ticket of the component); rows without a ticket get null.

    Only tickets that ever share a row with another one are in `components`; all others are
    groups of their own and need no shuffle partner.
    """
    own = rows.withColumn("node", F.when(F.size("tickets") > 0, node("agent", F.get("tickets", F.lit(0)))))
    joined = salted_join(own, components, ["node"], hot_rows=hot_rows, at_most=known_rows(rows))
    return joined.select(*rows.columns, F.coalesce("root", "node").alias("gid"))
