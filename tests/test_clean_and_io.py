import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlattice.operators import clean
from flowlattice.sources import sinks, tables
from flowlattice.sources.scratch import cut_lineage
from flowlattice.sources.tables import TxGraph
from flowlattice.streaming.timeline import windowed_counts


def test_label_guard_walks_nested_types():
    leaf = T.StructType([T.StructField("Is_Fraud", T.IntegerType())])
    for kind in (leaf, T.ArrayType(leaf), T.MapType(T.StringType(), leaf)):
        with pytest.raises(ValueError, match="Is_Fraud"):
            clean.require_unlabelled(T.StructType([T.StructField("a", kind)]))
    clean.require_unlabelled(T.StructType([T.StructField("amount", T.DoubleType())]))


def test_normalize_and_invalid_rows(spark):
    rows = [("a", "b", 1, 2.0, "T", 0), ("", "b", 1, 2.0, "T", 0), ("a", "b", 1, -2.0, "T", 0), ("a", "b", 1, float("nan"), "T", 0), ("a", "b", 1, float("inf"), "T", 0), ("a", "b", 1, 2.0, "T", 2), ("a", None, 1, 2.0, "T", 1)]
    e = spark.createDataFrame(rows, "src string, dst string, step long, amount double, type string, isFraud int")
    assert clean.invalid_edges(e).count() == 6
    out = clean.normalize_edges(e.limit(1), event_id=None).first()
    assert out.payment_currency == clean.NO_CURRENCY and len(out.event_key) == 64 and out.isFraud == 0.0
    with pytest.raises(ValueError):
        clean.normalize_edges(e.drop("type"))


def test_integrity_and_multiset_difference(spark):
    v = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    e = spark.createDataFrame([("a", "b"), ("a", "a"), ("x", "b"), ("a", None)], "src string, dst string")
    r = clean.integrity(TxGraph(v, e)).first()
    assert (r.n_vertices, r.null_ids, r.repeated_ids, r.n_edges, r.null_endpoints, r.self_loops, r.dangling_src, r.dangling_dst) == (4, 1, 1, 4, 1, 1, 1, 0)
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,), (None,)], "x int")
    assert tuple(clean.multiset_difference(a, b).first()) == (2, 2)
    assert tuple(clean.multiset_difference(a, a).first()) == (0, 0)


def test_checkers_reject(spark):
    a = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.5)], "k int, n long, x double")
    assert clean.compare_values(a, a, ["k"], ["n"], ["x"]).count() == 0
    assert clean.compare_values(a, a.withColumn("x", F.col("x") + 1e-6), ["k"], ["n"], ["x"]).count() == 2
    assert clean.compare_values(a, a.withColumn("n", F.lit(2)), ["k"], ["n"], ["x"]).count() == 1
    assert clean.same_keys(a, a.where("k = 1"), ["k"]).count() == 1
    assert clean.repeated_keys(a.union(a.limit(1)), ["k"]).count() == 1


def test_interbank_etl(spark, tmp_path):
    header = ",".join(tables.INTERBANK_HEADER)
    (tmp_path / "t.csv").write_text("﻿" + header + "\n2022/09/01 00:20,010,8000,0012,9000,3.5,US Dollar,3.5,US Dollar,Wire,1\n2022/09/01 00:21,10,8000,12,7777,1.0,Euro,1.0,Euro,Cash,0\n", encoding="utf-8")
    tables.check_header(spark, str(tmp_path / "t.csv"), tables.INTERBANK_HEADER)
    with pytest.raises(ValueError):
        tables.check_header(spark, str(tmp_path / "t.csv"), tables.INTERBANK_HEADER[::-1])
    raw = spark.read.schema(tables.INTERBANK_CSV).option("header", True).option("enforceSchema", True).csv(str(tmp_path / "t.csv"))
    e = clean.interbank_edges(raw)
    assert [(r.src, r.dst) for r in e.orderBy("step").collect()] == [("10_8000", "12_9000"), ("10_8000", "12_7777")]
    assert e.agg(F.min("step")).first()[0] == 1661991600
    accounts = spark.createDataFrame([("Bank", "0010", "8000", "e", "Corp #1"), ("Bank2", "12", "9000", "e", "Sole #2"), ("B", "x1", "1", "e", "Bad")], "bank_name string, bank_id string, account string, entity_id string, entity_name string")
    with pytest.raises(ValueError, match="1 bank"):
        clean.interbank_vertices(accounts, e)
    assert tuple(clean.bank_probe(accounts).first()) == (2, 1, 1)
    accounts = accounts.where("bank_id <> 'x1'")
    v = {r.id: r for r in clean.interbank_vertices(accounts.unionAll(accounts), e).collect()}
    assert v["10_8000"].account_type == "Corp" and v["12_7777"].account_type == "External/Unknown" and len(v) == 3
    checks = clean.interbank_contract(clean.interbank_vertices(accounts, e), e, raw, accounts)
    assert {r.check: r.failures for r in checks.where("NOT passed").collect()} == {"vertex named by an account": 1, "vertex bank_name present": 1, "vertices as many as raw accounts": 1}
    with pytest.raises(ValueError, match="named by an account"):
        clean.quality_gate(checks)
    whole = accounts.unionByName(spark.createDataFrame([("B", "12", "7777", "e", "Corp #3")], accounts.schema))
    clean.quality_gate(clean.interbank_contract(clean.interbank_vertices(whole, e), e, raw, whole))
    broken = e.withColumn("amount", F.when(F.col("step") == 1991, 1.0).otherwise(-F.col("amount")))
    assert {r.check for r in clean.interbank_contract(clean.interbank_vertices(whole, e), broken, raw, whole).where("NOT passed").collect()} == {"edge amount not negative"}


def test_mobile_etl(spark):
    raw = spark.createDataFrame([(1, "PAYMENT", 5.0, "C1", 9.0, 4.0, "M1", 0.0, 0.0, 0, 0), (2, "TRANSFER", 2.0, "C2", 2.0, 0.0, "C1", 4.0, 6.0, 1, 0)], tables.MOBILE_CSV)
    v = {r.id: (r.account_type, r.balance) for r in clean.mobile_vertices(raw).collect()}
    assert v == {"C1": ("Customer", 6.0), "M1": ("Merchant", 0.0), "C2": ("Customer", 0.0)}
    assert clean.mobile_edges(raw).columns == ["src", "dst", "amount", "step", "type", "isFraud"]


def test_other_prefixes_are_unknown(spark):
    raw = spark.createDataFrame([(1, "PAYMENT", 5.0, "C1", 9.0, 4.0, "X1", 0.0, 0.0, 0, 0)], tables.MOBILE_CSV)
    assert {r.id: r.account_type for r in clean.mobile_vertices(raw).collect()} == {"C1": "Customer", "X1": "Unknown"}


def contract_row(**changes):
    return {"event_id": 1, "src": "a", "dst": "b", "step": 1.0, "amount": 2.0, "type": "T", "isFraud": 0.0, "payment_currency": "U", "receiving_currency": "U"} | changes


CONTRACT = "event_id long, src string, dst string, step double, amount double, type string, isFraud double, payment_currency string, receiving_currency string"


@pytest.mark.parametrize("bad", [{"src": " "}, {"dst": None}, {"step": 1.5}, {"step": None}, {"amount": -1.0}, {"amount": float("inf")}, {"amount": float("nan")}, {"type": ""}, {"isFraud": 2.0}, {"isFraud": None}, {"payment_currency": " "}, {"receiving_currency": None}])
def test_edge_contract_is_enforced(spark, bad):
    with pytest.raises(ValueError):
        clean.normalize_edges(spark.createDataFrame([contract_row(**bad)], CONTRACT))


def test_event_keys_tell_records_apart(spark):
    rows = [contract_row(), contract_row(event_id=2), contract_row(amount=2.001), contract_row(src="a|b", dst="c"), contract_row(src="a", dst="b|c"), contract_row(isFraud=1.0)]
    keys = [r.event_key for r in clean.normalize_edges(spark.createDataFrame(rows, CONTRACT).coalesce(1)).collect()]
    assert keys[0] == keys[1] == keys[5] and len(set(keys)) == 4
    body = '{"amount":2.0,"dst":"b","payment_currency":"U","receiving_currency":"U","src":"a","step":1,"type":"T"}'
    assert keys[0] == hashlib.sha256(body.encode()).hexdigest()
    plain = spark.createDataFrame([contract_row()], CONTRACT).drop(*clean.CURRENCY_COLUMNS)
    assert clean.normalize_edges(plain).first().payment_currency == clean.NO_CURRENCY


def test_row_numbers(spark):
    e = spark.range(50).selectExpr("'a' AS src", "'b' AS dst").repartition(4)
    numbered = clean.index_events(e)
    assert numbered.select("event_id").distinct().count() == 50 and numbered.select("event_id").exceptAll(numbered.select("event_id")).isEmpty()
    with pytest.raises(ValueError):
        clean.index_events(numbered)


def test_compare_values_wants_the_same_keys(spark):
    want = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 1.5)], "k string, n long, x double")
    text = want.selectExpr("k", "string(n) AS n", "string(x) AS x")
    assert clean.compare_values(text, want, ["k"], ["n"], ["x"]).isEmpty()
    for bad in (text.where("k = 'a'"), text.unionAll(text), text.withColumn("k", F.lit(" ")), text.withColumn("n", F.lit("1.5")), text.withColumn("x", F.lit("NaN"))):
        with pytest.raises(ValueError):
            clean.compare_values(bad, want, ["k"], ["n"], ["x"])
    assert clean.compare_values(text.withColumn("x", F.lit("0.5")), want, ["k"], ["n"], ["x"]).count() == 1
    with pytest.raises(ValueError):
        clean.require_equal(text.withColumn("n", F.lit("1")), want, ["k"], ["n"], ["x"], "t")


def test_strict_graph_verification(spark):
    v = spark.createDataFrame([("C1", "Customer", 1.0), ("M1", "Merchant", 0.0)], "id string, account_type string, balance double")
    e = spark.createDataFrame([("C1", "M1", 2.0, 3, "PAYMENT", 0)], "src string, dst string, amount double, step int, type string, isFraud int")
    types = ["PAYMENT", "TRANSFER"]
    assert clean.verify_graph(TxGraph(v, e), types, (1, 744)).first().n_edges == 1
    bad = [
        TxGraph(v.unionAll(v), e), TxGraph(v.limit(0), e.limit(0)), TxGraph(v.where("id = 'C1'"), e), TxGraph(v, e.withColumn("step", F.lit(745))), TxGraph(v, e.withColumn("type", F.lit("X"))),
        TxGraph(v, e.withColumn("isFraud", F.lit(3))), TxGraph(v.withColumn("account_type", F.lit("Unknown")), e), TxGraph(v.withColumn("balance", F.lit(float("nan"))), e), TxGraph(v.drop("balance"), e),
    ]
    for g in bad:
        with pytest.raises(ValueError):
            clean.verify_graph(g, types, (1, 744))


def test_blocks_batches_and_json(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).withColumn("x", F.lit(None).cast("string")).write.parquet(str(tmp_path / f"b{k}"))
    frame = tables.read_blocks(spark, [str(tmp_path / f"b{k}") for k in range(3)])
    assert frame.count() == 30 and tables.count_rows(spark, str(tmp_path / "b1")) == 10
    assert [len(b) for b in tables.row_batches(frame, 12)] == [12, 12, 6]
    with pytest.raises(Exception):
        spark.range(1).withColumnRenamed("id", "other").write.parquet(str(tmp_path / "odd"))
        tables.read_blocks(spark, [str(tmp_path / "b0"), str(tmp_path / "odd")]).count()
    assert sinks.write_json_records(frame.orderBy("id").limit(2), tmp_path / "x.json") == 2
    assert json.loads((tmp_path / "x.json").read_text()) == [{"id": 0, "x": None}, {"id": 1, "x": None}]
    sinks.write_single_csv(spark.range(1), tmp_path / "x.csv", "utf-8-sig")
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfid")


def test_documented_cycles(spark, tmp_path):
    def line(a, b, amount):
        return f"2022/09/01 00:20,0{a},X{a},0{b},X{b},{amount},US Dollar,{amount},US Dollar,Wire,1\n"

    closed = line(1, 2, 5.0) + line(2, 3, 6.0) + line(3, 1, 7.0)
    text = "".join(f"BEGIN LAUNDERING ATTEMPT - {k}\n{body}END LAUNDERING ATTEMPT - {k}\n" for k, body in (("CYCLE:  Max 3 hops", closed), ("CYCLE", closed.replace("03,X3", "04,X4", 1)), ("STACK", closed), ("CYCLE", line(1, 2, 1.0))))
    (tmp_path / "p.txt").write_text(text)
    blocks = tables.read_pattern_blocks(spark, str(tmp_path / "p.txt"))
    assert {r.kind: (r.blocks, r.transactions) for r in tables.pattern_counts(blocks).collect()} == {"CYCLE": (3, 7), "STACK": (1, 3)}
    cycles = tables.pattern_cycles(blocks)
    assert [(r.block, r.accounts) for r in cycles.collect()] == [(1, ["1_X1", "2_X2", "3_X3"])]
    e = spark.createDataFrame([("1_X1", "2_X2", "2022/09/01 00:20", 5.0, "US Dollar", 1)] * 2 + [("2_X2", "3_X3", "2022/09/01 00:20", 6.0, "US Dollar", 0)], "src string, dst string, timestamp string, amount double, payment_currency string, isFraud int")
    assert [r.matching_rows for r in tables.documented_matches(cycles, e).orderBy("hop").collect()] == [2, 0, 0]


def test_samples(spark):
    e = spark.range(1000).selectExpr("id AS event_id", "concat('a', id % 50) AS src", "concat('b', id % 30) AS dst", "int(id % 10 = 0) AS isFraud")
    s = clean.stratified_sample(e, 17, 300)
    assert s.where("isFraud = 1").count() == 17 and 200 < s.count() < 400
    for n, rows in ((101, e), (5, e.where("isFraud = 1"))):
        with pytest.raises(ValueError):
            clean.stratified_sample(rows, n, 300)
    g = TxGraph(e.selectExpr("src AS id").distinct().union(e.selectExpr("dst").distinct()), e)
    sub = clean.induced_sample(g, F.col("event_id") < 5)
    assert sub.edges.count() == 5 and sub.vertices.count() == 10


def test_graph_files_and_pattern_blocks(spark, tmp_path):
    g = TxGraph(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "a")], "src string, dst string"))
    g.write(str(tmp_path / "g"))
    assert TxGraph.read(spark, str(tmp_path / "g")).edges.count() == 1
    (tmp_path / "p.txt").write_text("BEGIN LAUNDERING ATTEMPT - CYCLE:  Max 3 hops\nx,1\ny,2\nEND LAUNDERING ATTEMPT - CYCLE\n\nBEGIN LAUNDERING ATTEMPT - FAN-OUT\nz\nEND LAUNDERING ATTEMPT\nstray\n")
    rows = tables.read_pattern_blocks(spark, str(tmp_path / "p.txt")).orderBy("line_no").collect()
    assert [(r.block, r.kind, r.line) for r in rows] == [(1, "CYCLE", "x,1"), (1, "CYCLE", "y,2"), (2, "FAN-OUT", "z")]


def test_csv_sink_is_atomic(spark, tmp_path):
    out = tmp_path / "x.csv"
    assert sinks.write_single_csv(spark.range(3), out) == 3 and out.read_text().splitlines() == ["id", "0", "1", "2"]
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.write_single_csv(bad, out)
    assert out.read_text().splitlines() == ["id", "0", "1", "2"] and [p.name for p in tmp_path.iterdir()] == ["x.csv"]


def test_manifest_detects_changes(tmp_path):
    (tmp_path / "in").write_text("a")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/part").write_text("b")
    made = [str(tmp_path / "in")], [str(tmp_path / "out")]
    sinks.write_manifest(tmp_path / "m.json", "t", *made, {"p": 1}, {})
    assert sinks.verify_manifest(tmp_path / "m.json", "t")["parameters"] == {"p": 1}
    with pytest.raises(ValueError):
        sinks.verify_manifest(tmp_path / "m.json", "other")
    body = json.loads((tmp_path / "m.json").read_text())
    (tmp_path / "bad.json").write_text(json.dumps(body | {"parameters": {}}))
    with pytest.raises(ValueError):
        sinks.verify_manifest(tmp_path / "bad.json", "t")
    (tmp_path / "out/part").write_text("c")
    with pytest.raises(ValueError):
        sinks.verify_manifest(tmp_path / "m.json", "t")


def test_stream_and_scratch(spark, tmp_path):
    rows = spark.range(100).selectExpr("timestamp_seconds(1704067200 + id * 3600) AS timestamp", "'T' AS type", "1.0D AS amount")
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM counts ORDER BY bucket_start").collect()
    assert [r.n for r in got] == [24, 24, 24, 24]
    assert cut_lineage(rows).count() == 100
