"""Command line: ``python -m flowlattice COMMAND``; one command per task of the engine."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlattice.operators import clean, graph, models, motifs
from flowlattice.plans.experiment import Experiment, Settings
from flowlattice.session import get_session
from flowlattice.sources import tables
from flowlattice.sources.sinks import write_json_records, write_single_csv
from flowlattice.sources.tables import TxGraph


def _show(frame: DataFrame) -> None:
    for row in frame.collect():
        print(json.dumps(row.asDict(recursive=True), default=str))


def etl_interbank(spark: SparkSession, a: argparse.Namespace) -> None:
    """Interbank CSVs to a checked graph."""
    tables.check_header(spark, a.transactions, tables.INTERBANK_HEADER)
    raw = spark.read.schema(tables.INTERBANK_CSV).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(a.transactions)
    accounts = spark.read.option("header", True).option("mode", "FAILFAST").csv(a.accounts).toDF("bank_name", "bank_id", "account", "entity_id", "entity_name")
    edges = clean.interbank_edges(raw)
    vertices = clean.interbank_vertices(accounts, edges)
    clean.quality_gate(clean.interbank_contract(vertices, edges, raw, accounts))
    whole = TxGraph(vertices, edges)
    whole.write(a.out)
    if a.sample:
        kept = clean.stratified_sample(edges, a.sample_positives, a.sample)
        ids = tables.endpoints(kept)
        TxGraph(vertices.join(ids, "id", "left_semi"), kept).write(f"{a.out}/sample")
    _show(clean.integrity(TxGraph.read(spark, a.out)))


def etl_mobile(spark: SparkSession, a: argparse.Namespace) -> None:
    """Mobile-money CSV to a graph."""
    raw = tables.read_csv(spark, a.transactions, tables.MOBILE_CSV)
    TxGraph(clean.mobile_vertices(raw), clean.mobile_edges(raw)).write(a.out)
    _show(clean.integrity(TxGraph.read(spark, a.out)))


def verify(spark: SparkSession, a: argparse.Namespace) -> None:
    """Strict verification of a graph."""
    _show(clean.verify_graph(TxGraph.read(spark, a.graph), a.types.split(","), (a.first_step, a.last_step), a.account_types.split(",")))


def profile(spark: SparkSession, a: argparse.Namespace) -> None:
    """Types, labels, currencies and blanks of a graph."""
    e = TxGraph.read(spark, a.graph).edges
    _show(e.groupBy("type").agg(F.count("*").alias("n"), F.sum("isFraud").alias("positives"), F.avg("amount").alias("avg_amount")).orderBy("type"))
    _show(clean.blank_counts(e))


def centrality(spark: SparkSession, a: argparse.Namespace) -> None:
    """Degrees, their distribution and PageRank."""
    g = TxGraph.read(spark, a.graph)
    degrees = graph.degrees(g.edges, g.vertices)
    rank = graph.pagerank(g.vertices, g.edges, a.iterations)
    degrees.join(rank, "id").write.mode("overwrite").parquet(f"{a.out}/centrality.parquet")
    found = spark.read.parquet(f"{a.out}/centrality.parquet")
    whole = graph.valid_distribution(graph.degree_distribution(found), g.vertices.count(), g.edges.count())
    write_single_csv(whole.orderBy("degree"), f"{a.notes}/degree_distribution.csv")
    write_single_csv(found.orderBy(F.desc("pagerank"), "id").limit(10), f"{a.notes}/top10_pagerank.csv")


def communities(spark: SparkSession, a: argparse.Namespace) -> None:
    """Label propagation with profiles, reconciled with the graph."""
    g = TxGraph.read(spark, a.graph)
    first = F.xxhash64("id")  # numbers, as the exported labels must be; shared ones are an error
    graph.label_propagation(g.vertices, g.edges, a.iterations, seed=first).write.mode("overwrite").parquet(f"{a.out}/communities.parquet")
    labels = spark.read.parquet(f"{a.out}/communities.parquet")
    summary, amounts = graph.community_profile(labels, g.vertices, g.edges), graph.community_amounts(labels, g.edges)
    summary.write.mode("overwrite").parquet(f"{a.out}/community_summary.parquet")
    amounts.write.mode("overwrite").parquet(f"{a.out}/community_amounts.parquet")
    summary, amounts = spark.read.parquet(f"{a.out}/community_summary.parquet"), spark.read.parquet(f"{a.out}/community_amounts.parquet")
    top = graph.largest(summary, 50)
    graph.community_faults(g, labels, summary, amounts, top)
    write_single_csv(top, f"{a.notes}/community_top50.csv")


def motif(spark: SparkSession, a: argparse.Namespace) -> None:
    """Static patterns and causal features."""
    e = TxGraph.read(spark, a.graph).edges
    e = e if "event_id" in e.columns else clean.index_events(e)
    cycles = motifs.triangles(e)
    cycles.write.mode("overwrite").parquet(f"{a.out}/cycles.parquet")
    features = motifs.motif_features(clean.normalize_edges(e).drop("isFraud", "event_key"), a.windows, a.seconds_per_step, a.typed)
    features.write.mode("overwrite").parquet(f"{a.out}/motif_features.parquet")
    write_json_records(spark.read.parquet(f"{a.out}/cycles.parquet").agg(F.count("*").alias("cycles"), F.sum("n").alias("combinations")), f"{a.notes}/motifs.json")


def experiment(spark: SparkSession, a: argparse.Namespace) -> None:
    """The whole protocol, resumed where a run stopped."""
    settings = Settings(models.Protocol(tuple(a.windows), min_leaf=a.min_leaf), a.seconds_per_step, a.typed, tuple(a.families.split(",")) if a.families else tuple(models.FAMILIES))
    run = Experiment(spark, TxGraph.read(spark, a.graph).edges, a.out, a.notes, settings)
    print(json.dumps(run.run(), indent=1))
    run.verify()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="flowlattice", description=__doc__)
    top.add_argument("--master")
    commands = top.add_subparsers(dest="command", required=True)

    def command(work, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(work.__name__.replace("_", "-"), help=work.__doc__)
        for name, settings in options:
            sub.add_argument(name, **settings)
        sub.set_defaults(work=work)

    needed = {"required": True}
    source, out, notes = ("--graph", needed), ("--out", needed), ("--notes", needed | {"help": "local folder for small reports"})
    motif_options = [("--windows", {"type": int, "nargs": "+", "default": [24, 168]}), ("--seconds-per-step", {"type": int, "default": 1}), ("--typed", {"action": "store_true"})]
    command(etl_interbank, ("--transactions", needed), ("--accounts", needed), out, ("--sample", {"type": int, "default": 0}), ("--sample-positives", {"type": int, "default": 89}))
    command(etl_mobile, ("--transactions", needed), out)
    command(verify, source, ("--types", {"default": "CASH_IN,CASH_OUT,PAYMENT,DEBIT,TRANSFER"}), ("--account-types", {"default": "Customer,Merchant"}), ("--first-step", {"type": int, "default": 1}), ("--last-step", {"type": int, "default": 744}))
    command(profile, source)
    command(centrality, source, out, notes, ("--iterations", {"type": int, "default": 10}))
    command(communities, source, out, notes, ("--iterations", {"type": int, "default": 5}))
    command(motif, source, out, notes, *motif_options)
    command(experiment, source, out, notes, *motif_options, ("--min-leaf", {"type": int, "default": 50}), ("--families", {"default": ""}))
    return top


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    a.work(get_session(master=a.master), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
