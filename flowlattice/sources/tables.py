"""Readers, and the two transaction graphs derived from the supplied tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_HOUR = 1704067200 // 3600  # hour of 2024-01-01 00:00 UTC
#: Event types as transaction types, and the currencies by event id (fixed values).
TX_TYPES = {"purchase": "TRANSFER", "click": "CASH_OUT", "view": "PAYMENT", "signup": "CASH_IN", "error": "DEBIT"}
CURRENCIES = ["USD", "EUR", "GBP"]

MOBILE_CSV = (
    "step INT, type STRING, amount DOUBLE, nameOrig STRING, oldbalanceOrg DOUBLE, newbalanceOrig DOUBLE, "
    "nameDest STRING, oldbalanceDest DOUBLE, newbalanceDest DOUBLE, isFraud SMALLINT, isFlaggedFraud SMALLINT"
)
#: The interbank header repeats ``Account``, so its columns are mapped by position.
INTERBANK_HEADER = ["Timestamp", "From Bank", "Account", "To Bank", "Account", "Amount Received", "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering"]
INTERBANK_CSV = (
    "timestamp STRING, from_bank STRING, from_account STRING, to_bank STRING, to_account STRING, amount_received DOUBLE, "
    "receiving_currency STRING, amount_paid DOUBLE, payment_currency STRING, payment_format STRING, is_laundering SMALLINT"
)


@dataclass(frozen=True)
class TxGraph:
    """A directed multigraph: ``vertices(id, ...)`` and ``edges(src, dst, ...)``."""

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> TxGraph:
        return cls(spark.read.parquet(f"{folder}/vertices.parquet"), spark.read.parquet(f"{folder}/edges.parquet"))

    def write(self, folder: str, mode: str = "overwrite") -> None:
        self.vertices.write.mode(mode).parquet(f"{folder}/vertices.parquet")
        self.edges.write.mode(mode).parquet(f"{folder}/edges.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_blocks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several Parquet folders of one schema as one frame, matched by name; other columns are an error."""
    if not paths:
        raise ValueError("no blocks")
    first, *rest = (spark.read.parquet(p) for p in paths)
    for block in rest:
        first = first.unionByName(block)
    return first


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet folder; without columns Spark answers from the footers."""
    return spark.read.parquet(path).count()


def row_batches(frame: DataFrame, size: int = 10_000) -> Iterator[list[Row]]:
    """Rows in lists of at most ``size``, a partition at a time on the driver."""
    held: list[Row] = []
    for row in frame.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def read_csv(spark: SparkSession, path: str, schema: str | None = None, required: Sequence[str] = ()) -> DataFrame:
    """CSV with a header; malformed rows fail, columns are strings without a schema."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    frame = (reader.schema(schema) if schema else reader).csv(path)
    missing = sorted(set(required) - set(frame.columns))
    if missing or len(set(frame.columns)) != len(frame.columns):
        raise ValueError(f"columns missing or repeated: {missing or frame.columns}")
    return frame


def check_header(spark: SparkSession, path: str, expected: Sequence[str]) -> None:
    """Raise unless the first line holds exactly the expected names, in order."""
    first = spark.read.text(path).first()
    found = next(csv.reader(io.StringIO(first[0].removeprefix("﻿"))), []) if first else []
    if found != list(expected):
        raise ValueError(f"header {found} differs from {list(expected)}")


def _mapped(column: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def event_edges(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    """The event graph's edges, in seconds or in hours since the start of 2024."""
    e = table(spark, sf_dir, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    currency = F.array(*[F.lit(c) for c in CURRENCIES])
    own = F.get(currency, (F.col("event_id") % 3).cast("int"))
    other = F.get(currency, ((F.col("event_id") + 1) % 3).cast("int"))
    return e.select(
        "event_id",
        F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("src"),
        F.concat(F.lit("A"), F.get_json_object("props", "$.k")).alias("dst"),
        (F.floor(seconds / 3600) - EPOCH_HOUR + 1 if hourly else seconds).cast("long").alias("step"),
        F.col("value").alias("amount"),
        _mapped(F.col("event_type"), TX_TYPES).alias("type"),
        own.alias("payment_currency"),
        F.when(F.col("event_id") % 10 == 0, other).otherwise(own).alias("receiving_currency"),
        F.when((F.col("value") > 120) & (F.col("event_id") % 3 == 0), 1).otherwise(0).alias("isFraud"),
    )


def event_features(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    """The event graph's edges without labels, as feature operators take them."""
    return event_edges(spark, sf_dir, hourly).drop("isFraud")


def clustered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event graph's rows with 19 of 20 receivers moved into the sender's eighth of the accounts, so that communities form."""
    e = event_edges(spark, sf_dir)
    sender, receiver = (F.substring(c, 2, 30).cast("long") for c in ("src", "dst"))
    near = F.concat(F.lit("A"), (F.floor(receiver / 8) * 8 + sender % 8).cast("string"))
    return e.withColumn("dst", F.when(F.col("event_id") % 20 == 0, F.col("dst")).otherwise(near))


def interbank_raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The order tables in the shape of the interbank CSVs: (transactions, accounts), bank numbers padded."""
    orders, lines, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    bank = lambda c: F.lpad(F.col(c).cast("string"), 5, "0")
    accounts = customers.select(bank("c_nationkey").alias("bank_id"), F.col("c_name").alias("account"), F.concat(F.lit("Corporation #"), "c_custkey").alias("entity_name"), F.col("c_nationkey").alias("nation")).unionByName(
        suppliers.select(bank("s_nationkey").alias("bank_id"), F.col("s_name").alias("account"), F.concat(F.lit("Partnership #"), "s_suppkey").alias("entity_name"), F.col("s_nationkey").alias("nation"))
    )
    accounts = accounts.join(nations, F.col("nation") == F.col("n_nationkey")).select("bank_id", "account", "entity_name", F.col("n_name").alias("bank_name"))
    paid = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    raw = paid.select(
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy/MM/dd HH:mm").alias("timestamp"), bank("c_nationkey").alias("from_bank"), F.col("c_name").alias("from_account"),
        bank("s_nationkey").alias("to_bank"), F.col("s_name").alias("to_account"), F.col("l_extendedprice").alias("amount_received"), F.lit("USD").alias("receiving_currency"),
        F.col("l_extendedprice").alias("amount_paid"), F.lit("USD").alias("payment_currency"), F.col("l_returnflag").alias("payment_format"), F.when(F.col("l_discount") > 0.09, 1).otherwise(0).cast("short").alias("is_laundering"),
    )
    return raw, accounts


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids on either side of an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def event_graph(spark: SparkSession, sf_dir: str, hourly: bool = False) -> TxGraph:
    edges = event_edges(spark, sf_dir, hourly)
    return TxGraph(endpoints(edges), edges)


def trade_graph(spark: SparkSession, sf_dir: str) -> TxGraph:
    """Customers paying suppliers: the large graph without cycles."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    edges = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("M"), F.col("l_suppkey").cast("string")).alias("dst"),
        day.cast("long").alias("step"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_returnflag").alias("type"),
        F.when(F.col("l_discount") > 0.09, 1).otherwise(0).alias("isFraud"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.lit("Customer").alias("account_type"),
        F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("string").alias("bank_id"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("Merchant").alias("account_type"),
        F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("string").alias("bank_id"),
    )
    return TxGraph(customers.unionByName(suppliers), edges)


def read_pattern_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a text file between ``BEGIN ... - KIND`` and ``END`` lines: block, kind, line_no, line.

    The file is small (a report), so its lines are numbered in one partition.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    running = Window.orderBy("line_no")
    begins = F.col("line").startswith("BEGIN")
    blocks = lines.withColumn("block", F.sum(F.when(begins, 1).otherwise(0)).over(running)).withColumn(
        "ended", F.sum(F.when(F.col("line").startswith("END"), 1).otherwise(0)).over(running)
    )
    kind = F.last(F.when(begins, F.trim(F.regexp_extract("line", r"-\s*([A-Z_-]+)", 1))), ignorenulls=True).over(running)
    return blocks.withColumn("kind", kind).where((F.col("block") > F.col("ended")) & ~begins & (F.trim("line") != "")).select("block", "kind", "line_no", "line")


def pattern_cycles(blocks: DataFrame, length: int = 3) -> DataFrame:
    """(block, payments, accounts): CYCLE blocks that are one closed walk of ``length`` distinct accounts, in file order.

    ``blocks`` come from :func:`read_pattern_blocks`; a line is a row of the interbank CSV.
    """
    f = F.split("line", ",")
    account = lambda bank, name: F.concat(f[bank].try_cast("long").cast("string"), F.lit("_"), F.trim(f[name]))
    pay = F.struct("line_no", account(1, 2).alias("src"), account(3, 4).alias("dst"), F.trim(f[0]).alias("timestamp"), f[7].try_cast("double").alias("amount"), F.trim(f[8]).alias("payment_currency"))
    walks = blocks.where(F.col("kind") == "CYCLE").groupBy("block").agg(F.array_sort(F.collect_list(pay)).alias("payments"))
    source = F.transform("payments", lambda p: p["src"])
    target = F.transform("payments", lambda p: p["dst"])
    closed = target == F.concat(F.slice(source, 2, length), F.slice(source, 1, 1))
    return walks.where((F.size("payments") == length) & (F.size(F.array_distinct(source)) == length) & closed).select("block", "payments", source.alias("accounts"))


def pattern_counts(blocks: DataFrame) -> DataFrame:
    """(kind, blocks, transactions) of a pattern file."""
    return blocks.groupBy("kind").agg(F.count_distinct("block").alias("blocks"), F.count("*").alias("transactions"))


def documented_matches(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """(block, hop, src, dst, timestamp, amount, payment_currency, matching_rows): each payment of documented cycles and its labelled rows.

    ``edges`` have timestamp as text of the same form; a payment without a row is an error for the caller to raise.
    """
    paid = cycles.select("block", F.posexplode("payments").alias("hop", "p")).select("block", "hop", "p.src", "p.dst", "p.timestamp", "p.amount", "p.payment_currency")
    keys = ["src", "dst", "timestamp", "amount", "payment_currency"]
    known = edges.where("isFraud = 1").groupBy(*keys).agg(F.count("*").alias("matching_rows"))
    return paid.join(known, keys, "left").fillna(0, ["matching_rows"]).select("block", "hop", *keys, "matching_rows")
