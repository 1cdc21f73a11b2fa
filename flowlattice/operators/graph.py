"""Degrees, PageRank, label propagation and community profiles.

The iterative operators accept group columns, so that the graphs of several
snapshots go through the same few shuffles.  Every iteration is one join and one
or two aggregations; lineage is cut every few iterations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlattice.operators import clean
from flowlattice.sources.scratch import cut_lineage
from flowlattice.sources.tables import TxGraph


def degrees(edges: DataFrame, vertices: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., id, inDegree, outDegree, degree) in transactions; with vertices, isolates have zeros."""
    by = list(by)
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    rows = edges.select(*by, F.inline(ends))
    if vertices is not None:
        rows = rows.unionByName(vertices.select(*by, "id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return rows.groupBy(*by, "id").agg(F.sum("i").alias("inDegree"), F.sum("o").alias("outDegree")).withColumn("degree", F.col("inDegree") + F.col("outDegree"))


def degree_distribution(degree_table: DataFrame) -> DataFrame:
    """(degree, account_count, proportion)."""
    counts = degree_table.groupBy("degree").agg(F.count("*").alias("account_count"))
    total = degree_table.agg(F.count("*").alias("__n"))
    return counts.join(F.broadcast(total), F.lit(True)).select("degree", "account_count", (F.col("account_count") / F.col("__n")).alias("proportion"))


def valid_distribution(table: DataFrame, vertices: int, edges: int) -> DataFrame:
    """The distribution if it is whole: distinct degrees, every account, twice the edges in degrees; an error otherwise."""
    checked = clean.numeric(table.select("degree", "account_count"), ["degree", "account_count"])
    row = checked.agg(
        F.count("*").alias("bins"), F.count_distinct("degree").alias("distinct_bins"), F.count_if((F.col("degree") < 0) | (F.col("account_count") <= 0)).alias("bad"),
        F.sum("account_count").alias("accounts"), F.sum(F.col("degree") * F.col("account_count")).alias("ends"),
    ).first()
    if not row["bins"] or row["bins"] != row["distinct_bins"] or row["bad"]:
        raise ValueError("empty, repeated or negative degree bins")
    if row["accounts"] != vertices or row["ends"] != 2 * edges:
        raise ValueError("the distribution lost accounts or transactions")
    return checked.withColumn("proportion", F.col("account_count") / F.lit(vertices))


def links(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Parallel edges as one row with their multiplicity."""
    return edges.groupBy(*by, "src", "dst").agg(F.count("*").alias("mult"))


def pagerank(vertices: DataFrame, edges: DataFrame, iterations: int = 10, reset: float = 0.15, by: Sequence[str] = (), cut_every: int = 5) -> DataFrame:
    """(by..., id, pagerank): start 1, fixed iterations, dangling mass restored by a final scaling to the number of vertices."""
    by = list(by)
    pairs = links(edges, by)
    out = pairs.groupBy(*by, "src").agg(F.sum("mult").alias("total"))
    weights = cut_lineage(pairs.join(out, [*by, "src"]).select(*by, "src", "dst", (F.col("mult") / F.col("total")).alias("w")), "weights")
    base = cut_lineage(vertices.select(*by, "id"), "ids")
    ranks = base.withColumn("rank", F.lit(1.0))
    for k in range(iterations):
        sent = ranks.withColumnRenamed("id", "src").join(weights, [*by, "src"]).select(*by, F.col("dst").alias("id"), ((1 - reset) * F.col("rank") * F.col("w")).alias("rank"))
        # a base row per vertex carries the reset, so one aggregation ends the step
        ranks = base.withColumn("rank", F.lit(reset)).unionByName(sent).groupBy(*by, "id").agg(F.sum("rank").alias("rank"))
        if (k + 1) % cut_every == 0:
            ranks = cut_lineage(ranks, "ranks")
    total = ranks.groupBy(*by).agg((F.count("*") / F.sum("rank")).alias("scale")) if by else ranks.agg((F.count("*") / F.sum("rank")).alias("scale"))
    scaled = ranks.join(F.broadcast(total), by) if by else ranks.join(F.broadcast(total), F.lit(True))
    return scaled.select(*by, "id", (F.col("rank") * F.col("scale")).alias("pagerank"))


def pagerank_probability(vertices: DataFrame, edges: DataFrame, iterations: int = 30, damping: float = 0.85, repair_dangling: bool = True, cut_every: int = 5) -> DataFrame:
    """(id, probability) after fixed iterations of the random surfer, from 1/n.

    With ``repair_dangling`` an account without payments jumps anywhere, and the sum
    stays 1; without, its mass is lost.  An iteration is one join and one aggregation;
    the dangling mass comes from the same rows.
    """
    pairs = links(edges)
    out = pairs.groupBy("src").agg(F.sum("mult").alias("total"))
    weights = cut_lineage(pairs.join(out, "src").select("src", "dst", (F.col("mult") / F.col("total")).alias("w")), "weights")
    base = cut_lineage(vertices.select("id").join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")), "ids")
    n = base.count()
    ranks = base.withColumn("p", F.lit(1.0 / n))
    for k in range(iterations):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("p"))), F.lit(0.0))).first()[0] if repair_dangling else 0.0
        sent = ranks.select(F.col("id").alias("src"), "p").join(weights, "src").select(F.col("dst").alias("id"), F.lit(False).alias("dangling"), (damping * F.col("p") * F.col("w")).alias("p"))
        floor = (1 - damping) / n + damping * lost / n
        ranks = base.withColumn("p", F.lit(floor)).unionByName(sent).groupBy("id").agg(F.max("dangling").alias("dangling"), F.sum("p").alias("p"))
        if (k + 1) % cut_every == 0 or repair_dangling:
            ranks = cut_lineage(ranks, "ranks")
    return ranks.select("id", F.col("p").alias("probability"))


def vertex_number(column: Column) -> Column:
    """The digits of an id such as ``A12`` as a number."""
    return F.substring(column, 2, 30).cast("long")


def label_propagation(vertices: DataFrame, edges: DataFrame, iterations: int = 5, seed: Column | None = None, by: Sequence[str] = (), cut_every: int = 3) -> DataFrame:
    """(by..., id, label): synchronous updates over undirected links; most votes win, then the smallest label.

    A self-loop votes twice; an isolate keeps its label.  ``seed`` gives a vertex's
    first label (its number by default, any ordered type); seeds that are null or
    that two vertices share are an error.
    """
    if iterations <= 0:
        raise ValueError("iterations must be positive")
    by = list(by)
    pairs = links(edges, by)
    both = pairs.select(*by, F.col("src").alias("id"), F.col("dst").alias("other"), "mult").unionByName(pairs.select(*by, F.col("dst").alias("id"), F.col("src").alias("other"), "mult"))
    both = cut_lineage(both, "links")
    labels = cut_lineage(vertices.select(*by, "id", (vertex_number(F.col("id")) if seed is None else seed).alias("label")), "labels")
    if not labels.groupBy(*by, "label").agg(F.count("*").alias("n")).where("n > 1 OR label IS NULL").isEmpty():
        raise ValueError("first labels are null or shared by several vertices; give a seed that tells them apart, such as the id")
    for k in range(iterations):
        votes = both.join(labels.withColumnRenamed("id", "other"), [*by, "other"]).select(*by, "id", "label", "mult")
        kept = labels.select(*by, "id", "label", F.lit(0).cast("long").alias("mult"))
        counted = votes.unionByName(kept).groupBy(*by, "id", "label").agg(F.sum("mult").alias("votes"))
        best = F.min(F.struct((-F.col("votes")).alias("v"), F.col("label"))).getField("label")
        labels = counted.groupBy(*by, "id").agg(best.alias("label"))
        if (k + 1) % cut_every == 0 and k + 1 < iterations:
            labels = cut_lineage(labels, "labels")
    return labels


def community_profile(labels: DataFrame, vertices: DataFrame, edges: DataFrame, digits: int = 2) -> DataFrame:
    """Members and transactions of each community; transactions count where they start."""
    names = set(vertices.columns)
    members = labels.join(vertices, "id").groupBy("label").agg(
        F.count("*").alias("member_count"),
        *([F.count_if(F.col("account_type") == "Customer").alias("customer_count"), F.count_if(F.col("account_type") == "Merchant").alias("merchant_count")] if "account_type" in names else []),
        *([F.count_distinct("bank_id").alias("unique_banks_count")] if "bank_id" in names else []),
        *([F.round(F.avg("balance"), digits).alias("avg_balance"), F.max("balance").alias("max_balance")] if "balance" in names else []),
    )
    of = labels.select("id", "label")
    placed = edges.join(of.select(F.col("id").alias("src"), "label"), "src").join(of.select(F.col("id").alias("dst"), F.col("label").alias("to_label")), "dst")
    sent = placed.groupBy("label").agg(
        F.count("*").alias("total_tx_count"), F.sum("isFraud").cast("long").alias("positive_tx_count"), F.count_if(F.col("label") == F.col("to_label")).alias("internal_tx_count")
    )
    counts = ["total_tx_count", "positive_tx_count", "internal_tx_count"]
    least = F.greatest(F.col("total_tx_count"), F.lit(1))
    return (
        members.join(sent, "label", "left")
        .fillna(0, counts)
        .withColumn("cross_tx_count", F.col("total_tx_count") - F.col("internal_tx_count"))
        .withColumn("positive_rate", F.round(F.col("positive_tx_count") / least, 4))
        .withColumn("internal_ratio", F.round(F.col("internal_tx_count") / least, 4))
    )


def community_amounts(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, payment_currency, total_tx_count, total_tx_amount) by source community."""
    placed = edges.join(labels.select(F.col("id").alias("src"), "label"), "src")
    return placed.groupBy("label", "payment_currency").agg(F.count("*").alias("total_tx_count"), F.round(F.sum("amount"), 4).alias("total_tx_amount"))


def canonical_partition(labels: DataFrame) -> DataFrame:
    """(id, anchor): a community is named by its smallest member."""
    anchors = labels.groupBy("label").agg(F.min("id").alias("anchor"))
    return labels.join(anchors, "label").select("id", "anchor")


def partition_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row: accounts whose community differs, up to renaming."""
    a, b = canonical_partition(current), canonical_partition(previous).withColumnRenamed("anchor", "before")
    return a.join(b, "id", "full").agg(F.count("*").alias("accounts"), F.count_if(~F.col("anchor").eqNullSafe(F.col("before"))).alias("changed"))


def community_faults(graph: TxGraph, assignment: DataFrame, summary: DataFrame, amounts: DataFrame, top: DataFrame | None = None, digits: int = 2) -> None:
    """Raise unless assignment, summary and amounts agree with the graph.

    The assignment must name every vertex once, with a label that is a number; the
    tables are recomputed from graph and assignment and compared key by key.
    """
    clean.require_keys(graph.vertices, ["id"], "vertices")
    clean.quality_gate(clean.check_table(graph.edges, {"currency present": clean.blank("payment_currency"), "amount finite": F.isnan("amount") | (F.abs("amount") == float("inf")), "label binary": ~F.col("isFraud").isin(0, 1)}))
    clean.require_keys(assignment, ["id"], "assignment")
    labels = clean.numeric(assignment, ["label"]).select("id", "label")
    if not clean.same_keys(labels, graph.vertices, ["id"]).isEmpty():
        raise ValueError("assignment: missing or foreign accounts")
    labels = cut_lineage(labels, "assignment")
    if not clean.dangling_edges(graph).isEmpty():
        raise ValueError("edges with unknown endpoints")
    want = cut_lineage(community_profile(labels, graph.vertices, graph.edges, digits), "profile")
    floats = [c for c in ("avg_balance", "max_balance", "positive_rate", "internal_ratio") if c in want.columns]
    counts = [c for c in want.columns if c.endswith("_count")]
    if "total_tx_amount" in summary.columns:
        raise ValueError("summary: amounts of several currencies in one column")
    clean.require_equal(summary, want, ["label"], counts, floats, "summary")
    if top is not None:
        clean.require_equal(top, largest(want, 50), ["label"], counts, floats, "largest communities")
    clean.require_equal(amounts, community_amounts(labels, graph.edges), ["label", "payment_currency"], ["total_tx_count"], ["total_tx_amount"], "amounts")


def largest(profile: DataFrame, n: int = 50) -> DataFrame:
    """The communities with most members; ties by label."""
    return profile.orderBy(F.desc("member_count"), "label").limit(n)
