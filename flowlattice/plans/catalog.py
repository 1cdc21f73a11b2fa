"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlattice.functions.scores import wilson
from flowlattice.operators import asof, clean, evaluate, graph, models, motifs, rules
from flowlattice.plans import oracles as o
from flowlattice.sources import tables
from flowlattice.sources.scratch import cut_lineage, scratch_dir
from flowlattice.functions.order import interpolated
from flowlattice.sources.tables import TxGraph, clustered_edges, endpoints, event_edges, event_features, event_graph, interbank_raw, table, trade_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(frame: DataFrame, names: list[str], digits: int = 9) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in names})


# --- scan and clean ----------------------------------------------------------


@query(f"WITH {o.EV} SELECT event_id, src, dst, step, amount, type, isFraud::DOUBLE AS isFraud, payment_currency, receiving_currency, {o.KEY} AS event_key FROM ev")
def tx_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.normalize_edges(event_edges(spark, sf_dir))


@query(f"WITH {o.EV} SELECT event_id, {o.KEY} AS event_key FROM ev")
def event_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.normalize_edges(event_edges(spark, sf_dir)).select("event_id", "event_key")


@query(f"""WITH {o.EV} SELECT count(*) AS invalid_rows FROM ev WHERE src IS NULL OR trim(src) = '' OR dst IS NULL OR trim(dst) = '' OR type IS NULL OR trim(type) = ''
  OR amount IS NULL OR amount < 0 OR isnan(amount) OR isinf(amount) OR step IS NULL OR isFraud NOT IN (0, 1)""")
def invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.invalid_edges(event_edges(spark, sf_dir)).agg(F.count("*").alias("invalid_rows"))


_BLANK = ["src", "dst", "step", "amount", "type", "payment_currency"]


@query(f"WITH {o.EV} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS n_blank FROM ev" for c in _BLANK))
def null_blank_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.blank_counts(event_edges(spark, sf_dir), _BLANK)


# vertices that never send are left out, so that some endpoints dangle
_PARTIAL = "pv AS (SELECT DISTINCT src AS id FROM ev WHERE event_id % 64 = 0)"


def _partial_graph(spark: SparkSession, sf_dir: str) -> TxGraph:
    edges = event_edges(spark, sf_dir)
    return TxGraph(edges.where("event_id % 64 = 0").select(F.col("src").alias("id")).distinct(), edges)


@query(f"""WITH {o.EV}, {_PARTIAL} SELECT (SELECT count(*) FROM pv) AS n_vertices, 0::BIGINT AS null_ids, 0::BIGINT AS repeated_ids, count(*) AS n_edges,
  count(*) FILTER (src IS NULL OR dst IS NULL) AS null_endpoints, count(*) FILTER (src = dst) AS self_loops,
  count(*) FILTER (src NOT IN (SELECT id FROM pv)) AS dangling_src, count(*) FILTER (dst NOT IN (SELECT id FROM pv)) AS dangling_dst FROM ev""")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.integrity(_partial_graph(spark, sf_dir))


@query(f"WITH {o.EV}, {_PARTIAL} SELECT event_id, src, dst FROM ev WHERE src NOT IN (SELECT id FROM pv) OR dst NOT IN (SELECT id FROM pv)")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dangling_edges(_partial_graph(spark, sf_dir)).select("event_id", "src", "dst")


@query(f"""WITH {o.EV}, r AS (SELECT src AS id, step, event_id, amount FROM ev UNION ALL SELECT dst, step, event_id, amount FROM ev)
  SELECT id, CASE WHEN id LIKE 'C%' THEN 'Customer' WHEN id LIKE 'M%' THEN 'Merchant' ELSE 'Unknown' END AS account_type, amount AS balance FROM r
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC, event_id DESC) = 1""".replace("amount AS balance FROM r", "amount AS balance FROM (SELECT DISTINCT * FROM r)"))
def vertex_latest_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.latest_balance(event_edges(spark, sf_dir))


@query(f"WITH {o.EV} SELECT type, count(*) AS n, sum(isFraud)::BIGINT AS positives, round(avg(amount), 6) AS avg_amount, round(sum(isFraud) / count(*), 9) AS positive_rate FROM ev GROUP BY type")
def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    return e.groupBy("type").agg(F.count("*").alias("n"), F.sum("isFraud").alias("positives"), F.round(F.avg("amount"), 6).alias("avg_amount"), F.round(F.sum("isFraud") / F.count("*"), 9).alias("positive_rate"))


@query(f"WITH {o.TRADE} SELECT type, substr(src, 1, 1) AS src_prefix, substr(dst, 1, 1) AS dst_prefix, count(*) AS n, sum(isFraud)::BIGINT AS positives FROM tr GROUP BY ALL")
def prefix_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trade_graph(spark, sf_dir).edges
    return e.groupBy("type", F.substring("src", 1, 1).alias("src_prefix"), F.substring("dst", 1, 1).alias("dst_prefix")).agg(F.count("*").alias("n"), F.sum("isFraud").alias("positives"))


@query(f"WITH {o.EV} SELECT payment_currency, receiving_currency, count(*) AS n, round(sum(amount), 4) AS total FROM ev GROUP BY ALL")
def currency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_edges(spark, sf_dir).groupBy("payment_currency", "receiving_currency").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("total"))


@query(f"WITH {o.EV} SELECT src AS id FROM ev INTERSECT SELECT dst FROM ev")
def sender_receiver_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    return e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))


_RAW = "a AS (SELECT src, dst, type, CAST(round(amount) AS BIGINT) AS amount FROM ev), b AS (SELECT src, dst, type, CAST(round(amount) AS BIGINT) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS amount FROM ev WHERE event_id % 89 <> 0)"


@query(f"WITH {o.EV}, {_RAW} SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS surplus")
def except_all_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    amount = F.round("amount").cast("long")
    raw = e.select("src", "dst", "type", amount.alias("amount"))
    broken = e.where("event_id % 89 <> 0").select("src", "dst", "type", (amount + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).alias("amount"))
    return clean.multiset_difference(broken, raw)


@query(f"WITH {o.EV}, s AS (SELECT * FROM ev WHERE event_id % 7 = 0) SELECT id, (SELECT count(*) FROM s WHERE src = id) AS sampled_out FROM (SELECT src AS id FROM s UNION SELECT dst FROM s)")
def induced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clean.induced_sample(event_graph(spark, sf_dir), F.col("event_id") % 7 == 0)
    out = s.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("sampled_out"))
    return s.vertices.join(out, "id", "left").fillna(0, ["sampled_out"])


@query("""SELECT c_custkey, CASE WHEN TRY_CAST(bank AS BIGINT) IS NOT NULL THEN CAST(TRY_CAST(bank AS BIGINT) AS VARCHAR) || '_' || c_name END AS account_id
  FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 11 = 0 THEN 'x' || c_nationkey ELSE lpad(CAST(c_nationkey AS VARCHAR), 6, '0') END AS bank FROM customer)""")
def bank_key_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    number = F.col("c_nationkey").cast("string")
    bank = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("x"), number)).otherwise(F.lpad(number, 6, "0"))
    return c.select("c_custkey", bank.alias("bank"), "c_name").select("c_custkey", clean.composite_account(F.col("bank"), F.col("c_name")).alias("account_id"))


@query(f"WITH {o.EVH} SELECT (floor((step - 1) / 24) * 24 + 1)::BIGINT AS bucket, count(*) AS n, round(avg(isFraud), 9) AS positive_rate FROM ev GROUP BY 1")
def timeline_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = (F.floor((F.col("step") - 1) / 24) * 24 + 1).cast("long").alias("bucket")
    return event_edges(spark, sf_dir, hourly=True).groupBy(bucket).agg(F.count("*").alias("n"), F.round(F.avg("isFraud"), 9).alias("positive_rate"))


@query(f"WITH {o.EV} SELECT isFraud, round(quantile_cont(amount, 0.5), 6) AS q50, round(quantile_cont(amount, 0.9), 6) AS q90, round(quantile_cont(amount, 0.99), 6) AS q99 FROM ev GROUP BY isFraud")
def amount_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interpolated(event_edges(spark, sf_dir), "amount", {"q50": 0.5, "q90": 0.9, "q99": 0.99}, "isFraud"), ["q50", "q90", "q99"], 6)


@query("SELECT 1 AS isFraud, 20 AS n")
def stratified_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_sample(spark, sf_dir).where("isFraud = 1").groupBy("isFraud").agg(F.count("*").cast("int").alias("n"))


@query()
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.stratified_sample(event_edges(spark, sf_dir), n_positive=20, n_total=500)


@query(f"WITH {o.EV} SELECT count(*) AS rows, count(*) AS distinct_ids FROM ev")
def indexed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.index_events(event_edges(spark, sf_dir).drop("event_id")).agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("distinct_ids"))


@query(f"SELECT count(*) AS numeric, count(*) FILTER (CAST(CAST(bank_id AS BIGINT) AS VARCHAR) <> bank_id) AS padded, 0::BIGINT AS not_numeric FROM {o.BANK}")
def bank_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.bank_probe(interbank_raw(spark, sf_dir)[1])


def _interbank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, raw transactions, raw accounts)."""
    raw, accounts = interbank_raw(spark, sf_dir)
    edges = clean.interbank_edges(raw)
    return clean.interbank_vertices(accounts, edges), edges, raw, accounts


@query(f"WITH {o.IBV} SELECT * FROM ibv")
def interbank_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interbank(spark, sf_dir)[0]


@query(f"WITH {o.IBE} SELECT src, dst, type, count(*) AS n, round(sum(amount), 4) AS total, min(step) AS first_step, max(step) AS last_step, sum(isFraud)::BIGINT AS positives FROM ibe GROUP BY ALL")
def interbank_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _interbank(spark, sf_dir)[1]
    return e.groupBy("src", "dst", "type").agg(
        F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("total"), F.min("step").cast("long").alias("first_step"), F.max("step").cast("long").alias("last_step"), F.sum("isFraud").alias("positives")
    )


@query("SELECT 0::BIGINT AS failures, count(*) AS checks FROM range(37)")
def interbank_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = clean.interbank_contract(*_interbank(spark, sf_dir))
    return checks.agg(F.sum("failures").alias("failures"), F.count("*").alias("checks"))


_MOBILE = """mo AS (SELECT (CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 + 1)::INT AS step, 'C' || user_id AS src, CASE WHEN event_id % 3 = 0 THEN 'M' WHEN event_id % 3 = 1 THEN 'X' ELSE 'C' END || json_extract_string(props, '$.k') AS dst, value AS amount,
  value * 2 AS bal_src, value * 3 AS bal_dst, event_type AS type, CASE WHEN value > 120 AND event_id % 3 = 0 THEN 1 ELSE 0 END AS isFraud FROM events)"""


def _mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in the shape of the mobile-money CSV."""
    e = table(spark, sf_dir, "events").join(event_edges(spark, sf_dir, hourly=True).select("event_id", "step", "isFraud"), "event_id")
    prefix = F.when(F.col("event_id") % 3 == 0, "M").when(F.col("event_id") % 3 == 1, "X").otherwise("C")
    return e.select(
        "step", F.col("event_type").alias("type"), F.col("value").alias("amount"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"), (F.col("value") * 2).alias("newbalanceOrig"),
        F.concat(prefix, F.get_json_object("props", "$.k")).alias("nameDest"), (F.col("value") * 3).alias("newbalanceDest"), "isFraud",
    )


@query(f"""WITH {_MOBILE}, r AS (SELECT src AS id, step, bal_src AS b FROM mo UNION ALL SELECT dst, step, bal_dst FROM mo)
  SELECT id, CASE substr(id, 1, 1) WHEN 'C' THEN 'Customer' WHEN 'M' THEN 'Merchant' ELSE 'Unknown' END AS account_type, round(max({{'s': step, 'b': b}}).b, 6) AS balance FROM r GROUP BY id""")
def mobile_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.mobile_vertices(_mobile(spark, sf_dir)), ["balance"], 6)


@query(f"WITH {_MOBILE} SELECT src, dst, amount, step, type, isFraud FROM mo")
def mobile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.mobile_edges(_mobile(spark, sf_dir))


@query(f"WITH {o.TRADE}, {o.TV} SELECT (SELECT count(*) FROM tv) AS n_vertices, count(*) AS n_edges, 0::BIGINT AS repeated_ids, 0::BIGINT AS dangling_src, 0::BIGINT AS dangling_dst FROM tr")
def verified_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.verify_graph(trade_graph(spark, sf_dir), ["A", "N", "R"], (0, 4000)).select("n_vertices", "n_edges", "repeated_ids", "dangling_src", "dangling_dst")


@query(f"WITH {o.EV} SELECT type, count(*) AS n, sum(isFraud)::BIGINT AS positives, round(sum(amount), 4) AS total FROM ev GROUP BY type")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event edges written as CSV and read back with a schema, malformed rows being an error."""
    folder = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    e = event_edges(spark, sf_dir).select("src", "dst", "type", "amount", "step", "isFraud")
    e.write.option("header", True).csv(folder)
    back = tables.read_csv(spark, folder, "src STRING, dst STRING, type STRING, amount DOUBLE, step BIGINT, isFraud INT", required=e.columns)
    return back.groupBy("type").agg(F.count("*").alias("n"), F.sum("isFraud").alias("positives"), F.round(F.sum("amount"), 4).alias("total"))


@query(f"WITH {o.EV} SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, sum(step)::BIGINT AS steps FROM ev")
def parquet_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event edges written as one Parquet folder per weekday and read back as one frame."""
    root = f"{scratch_dir(spark)}/blocks-{uuid.uuid4().hex}"
    e = event_edges(spark, sf_dir).withColumn("block", F.pmod(F.floor(F.col("step") / 86400), F.lit(7)).cast("int"))
    for k in range(7):
        e.where(F.col("block") == k).drop("block").write.parquet(f"{root}/{k}")
    return tables.read_blocks(spark, [f"{root}/{k}" for k in range(7)]).agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"), F.sum("step").alias("steps"))


# --- degrees, ranks, communities ---------------------------------------------

_DEG = "deg AS (SELECT id, sum(i)::BIGINT AS inDegree, sum(o)::BIGINT AS outDegree, (sum(i) + sum(o))::BIGINT AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM ev UNION ALL SELECT dst, 1, 0 FROM ev) GROUP BY id)"


@query(f"WITH {o.EV}, {_DEG} SELECT * FROM deg")
def degree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(event_edges(spark, sf_dir))


@query(f"""WITH {o.TRADE}, {o.TV}, d AS (SELECT id, sum(i)::BIGINT AS inDegree, sum(o)::BIGINT AS outDegree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM tr UNION ALL SELECT dst, 1, 0 FROM tr UNION ALL SELECT id, 0, 0 FROM tv) GROUP BY id)
  SELECT *, inDegree + outDegree AS degree FROM d""")
def trade_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade_graph(spark, sf_dir)
    return graph.degrees(g.edges, g.vertices)


@query(f"WITH {o.EV}, {_DEG} SELECT degree, count(*) AS account_count, round(count(*) / sum(count(*)) OVER (), 9) AS proportion FROM deg GROUP BY degree")
def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.degree_distribution(graph.degrees(event_edges(spark, sf_dir))), ["proportion"])


@query(f"""WITH {o.EV}, {o.TRADE}, {o.TV}, {_DEG}, td AS (SELECT id, sum(n)::BIGINT AS degree FROM (SELECT src AS id, 1 AS n FROM tr UNION ALL SELECT dst, 1 FROM tr UNION ALL SELECT id, 0 FROM tv) GROUP BY id)
  SELECT 'events' AS dataset, degree, count(*) AS account_count FROM deg GROUP BY degree UNION ALL SELECT 'trade', degree, count(*) FROM td GROUP BY degree""")
def degree_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade_graph(spark, sf_dir)
    sides = {"events": graph.degrees(event_edges(spark, sf_dir)), "trade": graph.degrees(g.edges, g.vertices)}
    return motifs.union_all([graph.degree_distribution(d).select(F.lit(name).alias("dataset"), "degree", "account_count") for name, d in sides.items()])


@query(f"WITH {o.EV}, {_DEG} SELECT id, inDegree, outDegree, degree FROM deg ORDER BY degree DESC, id LIMIT 10")
def top10_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(event_edges(spark, sf_dir)).orderBy(F.desc("degree"), "id").limit(10)


@query(f"WITH {o.EV}, {_DEG} SELECT degree, count(*) AS account_count, round(count(*) / sum(count(*)) OVER (), 9) AS proportion FROM deg GROUP BY degree")
def degree_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = event_graph(spark, sf_dir)
    table_ = graph.degree_distribution(graph.degrees(g.edges, g.vertices))
    return rounded(graph.valid_distribution(table_, g.vertices.count(), g.edges.count()), ["proportion"])


@query(f"WITH {o.EV}, {o.surfer_ctes(8)} SELECT id, round(p, 9) AS probability FROM s_8")
def pagerank_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = event_graph(spark, sf_dir)
    return rounded(graph.pagerank_probability(g.vertices, g.edges, iterations=8), ["probability"])


@query(f"WITH {o.EV}, {o.pagerank_ctes()} SELECT id, round(pagerank, 6) AS pagerank FROM pr")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = event_graph(spark, sf_dir)
    return rounded(graph.pagerank(g.vertices, g.edges), ["pagerank"], 6)


@query(f"""WITH {o.EV}, {_DEG}, {o.pagerank_ctes()}, f AS (SELECT id, sum(x)::BIGINT AS positive_out, sum(y)::BIGINT AS positive_in FROM (SELECT src AS id, isFraud AS x, 0 AS y FROM ev UNION ALL SELECT dst, 0, isFraud FROM ev) GROUP BY id)
  SELECT id, round(pagerank, 6) AS pagerank, inDegree, outDegree, positive_in, positive_out FROM pr JOIN deg USING (id) JOIN f USING (id) ORDER BY round(pagerank, 6) DESC, id LIMIT 10""")
def top10_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = event_graph(spark, sf_dir)
    top = rounded(graph.pagerank(g.vertices, g.edges), ["pagerank"], 6).orderBy(F.desc("pagerank"), "id").limit(10)
    side = F.array(F.struct(F.col("src").alias("id"), F.col("isFraud").alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.col("isFraud").alias("i")))
    posthoc = g.edges.select(F.inline(side)).groupBy("id").agg(F.sum("i").alias("positive_in"), F.sum("o").alias("positive_out"))
    return top.join(graph.degrees(g.edges), "id").join(posthoc, "id").select("id", "pagerank", "inDegree", "outDegree", "positive_in", "positive_out")


def _labels(spark: SparkSession, sf_dir: str, iterations: int = 5) -> tuple[TxGraph, DataFrame]:
    edges = clustered_edges(spark, sf_dir)
    g = TxGraph(endpoints(edges), edges)
    return g, graph.label_propagation(g.vertices, g.edges, iterations)


@query(f"WITH {o.EV}, {o.lpa_ctes()} SELECT id, label FROM lp")
def lpa_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = event_graph(spark, sf_dir)
    return graph.label_propagation(g.vertices, g.edges)


@query(f"WITH {o.EVC}, {o.lpa_ctes()} SELECT id, label FROM lp")
def lpa_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)[1]


_PROFILE = f"""{o.EVC}, {o.lpa_ctes()}, m AS (SELECT label, count(*) AS member_count FROM lp GROUP BY label),
  t AS (SELECT s.label, count(*) AS n, sum(isFraud) AS p, count(*) FILTER (s.label = d.label) AS i FROM ev JOIN lp s ON s.id = src JOIN lp d ON d.id = dst GROUP BY s.label),
  pf AS (SELECT label, member_count, coalesce(n, 0) AS total_tx_count, coalesce(p, 0)::BIGINT AS positive_tx_count, coalesce(i, 0) AS internal_tx_count, coalesce(n - i, 0) AS cross_tx_count,
    round(coalesce(p, 0) / greatest(coalesce(n, 0), 1), 4) AS positive_rate, round(coalesce(i, 0) / greatest(coalesce(n, 0), 1), 4) AS internal_ratio FROM m LEFT JOIN t USING (label))"""


@query(f"WITH {_PROFILE} SELECT * FROM pf")
def community_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, labels = _labels(spark, sf_dir)
    return graph.community_profile(cut_lineage(labels, "labels"), g.vertices, g.edges)


@query(f"WITH {_PROFILE} SELECT * FROM pf ORDER BY member_count DESC, label LIMIT 50")
def top50_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest(community_profile(spark, sf_dir), 50)


@query(f"WITH {_PROFILE} SELECT count(*) AS communities, sum(member_count)::BIGINT AS accounts, sum(total_tx_count)::BIGINT AS transactions FROM pf")
def community_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the communities, read back as text and reconciled with the graph."""
    g, labels = _labels(spark, sf_dir)
    labels = cut_lineage(labels, "labels")
    profile, amounts = graph.community_profile(labels, g.vertices, g.edges), graph.community_amounts(labels, g.edges)
    as_text = [cut_lineage(t.select(*[F.col(c).cast("string") for c in t.columns]), "text") for t in (labels, profile, amounts)]
    graph.community_faults(g, *as_text, top=graph.largest(profile, 50))
    return profile.agg(F.count("*").alias("communities"), F.sum("member_count").alias("accounts"), F.sum("total_tx_count").alias("transactions"))


def _trade_labels(spark: SparkSession, sf_dir: str) -> tuple[TxGraph, DataFrame]:
    """Communities of the trade graph: an account's bank stands for its community."""
    g = trade_graph(spark, sf_dir)
    return g, g.vertices.select("id", F.col("bank_id").cast("long").alias("label"))


@query(f"""WITH {o.TRADE}, {o.TV}, m AS (SELECT CAST(bank_id AS BIGINT) AS label, count(*) AS member_count, count(*) FILTER (account_type = 'Customer') AS customer_count, count(*) FILTER (account_type = 'Merchant') AS merchant_count,
    count(DISTINCT bank_id) AS unique_banks_count, round(avg(balance), 6) AS avg_balance, max(balance) AS max_balance FROM tv GROUP BY 1),
  t AS (SELECT CAST(s.bank_id AS BIGINT) AS label, count(*) AS n, sum(isFraud) AS p, count(*) FILTER (s.bank_id = d.bank_id) AS i FROM tr JOIN tv s ON s.id = src JOIN tv d ON d.id = dst GROUP BY 1)
  SELECT label, member_count, customer_count, merchant_count, unique_banks_count, avg_balance, max_balance, coalesce(n, 0) AS total_tx_count, coalesce(p, 0)::BIGINT AS positive_tx_count, coalesce(i, 0) AS internal_tx_count,
    coalesce(n - i, 0) AS cross_tx_count, round(coalesce(p, 0) / greatest(coalesce(n, 0), 1), 4) AS positive_rate, round(coalesce(i, 0) / greatest(coalesce(n, 0), 1), 4) AS internal_ratio FROM m LEFT JOIN t USING (label)""")
def bank_community_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, labels = _trade_labels(spark, sf_dir)
    return graph.community_profile(labels, g.vertices, g.edges, digits=6)


@query(f"WITH {o.EVC}, {o.lpa_ctes()} SELECT label, payment_currency, count(*) AS total_tx_count, round(sum(amount), 4) AS total_tx_amount FROM ev JOIN lp ON id = src GROUP BY ALL")
def community_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, labels = _labels(spark, sf_dir)
    return graph.community_amounts(labels, g.edges)


@query(f"WITH {o.EVC}, {o.lpa_ctes()} SELECT member_count, count(*) AS n FROM (SELECT label, count(*) AS member_count FROM lp GROUP BY label) GROUP BY 1")
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)[1].groupBy("label").agg(F.count("*").alias("member_count")).groupBy("member_count").agg(F.count("*").alias("n"))


_CHANGED = """a AS (SELECT id, min(id) OVER (PARTITION BY label) AS x FROM lp), b AS (SELECT id, min(id) OVER (PARTITION BY label) AS y FROM lq)
  SELECT count(*) AS accounts, count(*) FILTER (x IS DISTINCT FROM y) AS changed FROM a FULL JOIN b USING (id)"""


@query(f"WITH {o.EVC}, {o.lpa_ctes(iterations=5, name='lp')}, {o.lpa_ctes(iterations=5, name='lq')}, {_CHANGED}")
def community_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the same propagation, compared up to renaming."""
    return graph.partition_changes(_labels(spark, sf_dir)[1], _labels(spark, sf_dir)[1])


@query(f"WITH {o.EVC}, {o.lpa_ctes(iterations=3, name='lp')}, {o.lpa_ctes(iterations=1, name='lq')}, {_CHANGED}")
def community_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that still change community between the first and the third round."""
    return graph.partition_changes(_labels(spark, sf_dir, 3)[1], _labels(spark, sf_dir, 1)[1])


# --- motifs ------------------------------------------------------------------


@query(f"WITH {o.EV}, {o.tri()} SELECT a, b, c, n FROM tri")
def cycles_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.cycle_rotations(motifs.triangles(event_edges(spark, sf_dir)))


@query(f"WITH {o.EV}, {o.tri()} SELECT a, b, c, n AS transaction_combinations FROM tri WHERE a < b AND a < c")
def cycles_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.triangles(event_edges(spark, sf_dir)).withColumnRenamed("n", "transaction_combinations")


@query(f"WITH {o.EV}, {o.tri()} SELECT DISTINCT list_sort([a, b, c])[1] AS a, list_sort([a, b, c])[2] AS b, list_sort([a, b, c])[3] AS c FROM tri")
def cycles_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.unordered_triples(motifs.triangles(event_edges(spark, sf_dir)))


@query(f"WITH {o.EV}, big AS (SELECT * FROM ev WHERE amount > 40 AND payment_currency = 'USD'), {o.tri('big')} SELECT a, b, c, n FROM tri WHERE a < b AND a < c")
def cycles_thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.triangles(motifs.thresholded(event_edges(spark, sf_dir), 40.0, "USD"))


@query(f"WITH {o.EV}, pos AS (SELECT * FROM ev WHERE isFraud = 1), {o.tri('pos')} SELECT a, b, c, n FROM tri WHERE a < b AND a < c")
def cycles_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.triangles(event_edges(spark, sf_dir).where("isFraud = 1"))


@query(f"WITH {o.EV}, {o.tri()} SELECT sum(n)::BIGINT AS raw_matches, count(*) FILTER (a < b AND a < c) AS directed_cycles, (sum(n) FILTER (a < b AND a < c))::BIGINT AS combinations, (SELECT count(*) FROM (SELECT DISTINCT list_sort([a, b, c]) FROM tri)) AS unordered FROM tri")
def motif_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_lineage(motifs.triangles(event_edges(spark, sf_dir)), "triangles")
    counts = found.agg((3 * F.sum("n")).alias("raw_matches"), F.count("*").alias("directed_cycles"), F.sum("n").alias("combinations"))
    return counts.join(motifs.unordered_triples(found).agg(F.count("*").alias("unordered")), F.lit(True))


def _relay_sql(gap: str) -> str:
    return f"""WITH {o.EVH} SELECT x.event_id AS first_id, y.event_id AS second_id, x.src AS a, x.dst AS b, y.dst AS c, x.step AS first_step, y.step AS second_step, x.amount AS first_amount, y.amount AS second_amount, y.step - x.step AS gap
      FROM ev x JOIN ev y ON x.dst = y.src WHERE x.type = 'TRANSFER' AND y.type = 'CASH_OUT' AND x.amount > 10 AND y.amount > 10 AND x.src <> x.dst AND y.src <> y.dst AND x.src <> y.dst AND y.step - x.step BETWEEN {gap}"""


@query(_relay_sql("0 AND 24"))
def relay_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.relays(event_edges(spark, sf_dir, hourly=True), 10.0, 24)


@query(_relay_sql("1 AND 24"))
def relay_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.relays(event_edges(spark, sf_dir, hourly=True), 10.0, 24, strict=True)


@query(f"WITH {o.EV} SELECT x.src AS low, x.dst AS high, x.n AS forward, y.n AS backward FROM (SELECT src, dst, count(*) AS n FROM ev GROUP BY ALL) x JOIN (SELECT src, dst, count(*) AS n FROM ev GROUP BY ALL) y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def reciprocal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.reciprocal_pairs(event_edges(spark, sf_dir))


@query(f"WITH {o.EVH}, {o.fanin_ctes()} SELECT * FROM fan")
def fanin_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.fanin_features(event_features(spark, sf_dir, hourly=True))


W = (24, 168)


@query(f"WITH {o.EV}, {o.ELIG}, {o.star_sql(False, W)} SELECT * FROM star")
def star_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.star_features(event_features(spark, sf_dir), W, 1, typed_relay=False)


@query(f"WITH {o.EVH}, {o.ELIG}, {o.star_sql(True, W)} SELECT * FROM star")
def star_features_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.star_features(event_features(spark, sf_dir, hourly=True), W, 3600, typed_relay=True)


@query(f"WITH {o.EV}, {o.ELIG}, {o.pair_sql(False, W)} SELECT * FROM pair")
def reciprocal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.reciprocal_features(event_features(spark, sf_dir), W, 1, typed_relay=False)


@query(f"""WITH {o.EV}, {o.ELIG}, j AS (SELECT e.event_id, max({{'s': p.step, 'e': p.event_id}}) AS w FROM el e LEFT JOIN el p ON p.src = e.dst AND p.dst = e.src AND p.payment_currency = e.payment_currency AND p.step < e.step GROUP BY e.event_id)
  SELECT event_id, w.e AS reverse_event_id, w.s AS reverse_step FROM j""".replace("max({'s': p.step, 'e': p.event_id})", "max(CASE WHEN p.event_id IS NOT NULL THEN {'s': p.step, 'e': p.event_id} END)"))
def asof_reverse_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.latest_reverse(event_features(spark, sf_dir))


@query(f"WITH {o.EV}, {o.ELIG}, {o.cycles_sql(168)} SELECT event_id, first_id, second_id, a, b, c, payment_currency, gap_seconds, minimum_cycle_amount, round(amount_ratio, 9) AS amount_ratio FROM cyc")
def temporal_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motifs.temporal_cycles(event_features(spark, sf_dir), 168, 1), ["amount_ratio"])


@query(f"WITH {o.EV}, {o.ELIG}, {o.cycles_sql(168)}, {o.CYF} SELECT event_id, cycle3_count, round(cycle3_best_ratio, 9) AS cycle3_best_ratio, cycle3_min_gap, w.f AS witness_first, w.s AS witness_second FROM cyf")
def cycle_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motifs.cycle_features(motifs.temporal_cycles(event_features(spark, sf_dir), 168, 1)), ["cycle3_best_ratio"])


@query(f"WITH {o.EV}, {o.ELIG}, {o.motif_sql(W)} SELECT * REPLACE (round(cycle3_best_ratio, 9) AS cycle3_best_ratio) FROM mf")
def motif_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motifs.motif_features(event_features(spark, sf_dir), W, 1), ["cycle3_best_ratio"])


@query(f"WITH {o.EVH}, {o.ELIG}, {o.motif_sql((6, 24), True)} SELECT * REPLACE (round(cycle3_best_ratio, 9) AS cycle3_best_ratio) FROM mf")
def motif_features_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motifs.motif_features(event_features(spark, sf_dir, hourly=True), (6, 24), 3600, typed_relay=True), ["cycle3_best_ratio"])


_MOTIFS = {"fanin": "fanin_24h > 0", "fanout": "fanout_24h > 0", "relay": "relay_24h > 0", "reciprocal": "reciprocal_24h > 0", "cycle3": "cycle3_count > 0"}


@query(
    f"WITH {o.EV}, {o.ELIG}, {o.CUTS}, {o.motif_sql(W)}, al AS (SELECT mf.*, isFraud, step FROM mf JOIN ev USING (event_id)), t AS (SELECT 'full' AS scope, * FROM al UNION ALL SELECT 'test', al.* FROM al, cuts WHERE step > c4) "
    + " UNION ALL ".join(
        f"SELECT scope, '{m}' AS motif, count(*) AS transactions, sum(isFraud)::BIGINT AS positives, count(*) FILTER ({c}) AS covered_transactions, count(*) FILTER ({c} AND isFraud = 1) AS covered_positives, "
        f"round(count(*) FILTER ({c} AND isFraud = 1) / nullif(sum(isFraud), 0), 9) AS positive_coverage, round(count(*) FILTER ({c} AND isFraud = 1) / nullif(count(*) FILTER ({c}), 0), 9) AS positive_fraction_when_present, "
        f"round(sum(isFraud) / nullif(count(*), 0), 9) AS population_prevalence FROM t GROUP BY scope"
        for m, c in _MOTIFS.items()
    )
)
def motif_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    scopes = {"full": F.lit(True), "test": F.col("step") > asof.cutoffs(e)[4]}
    found = motifs.coverage(motifs.motif_features(e.drop("isFraud"), W, 1), e, {m: F.expr(c) for m, c in _MOTIFS.items()}, scopes)
    return rounded(found, ["positive_coverage", "positive_fraction_when_present", "population_prevalence"])


def _witnesses(e: DataFrame, per: int, typed: bool) -> DataFrame:
    return motifs.union_all([motifs.star_witnesses(e, f, 24, per, typed).select(F.lit(f).alias("family"), "event_id", "witness_id", "witness_step") for f in motifs.FAMILIES])


@query(f"WITH {o.EV}, {o.ELIG} " + " UNION ALL ".join(o.witness_sql(f, 24, 1) for f in motifs.FAMILIES))
def star_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _witnesses(event_features(spark, sf_dir), 1, False)


@query(f"WITH {o.EVH}, {o.ELIG} " + " UNION ALL ".join(o.witness_sql(f, 24, 3600, True) for f in motifs.FAMILIES))
def star_witnesses_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _witnesses(event_features(spark, sf_dir, hourly=True), 3600, True)


@query(f"""WITH {o.EV}, {o.ELIG}, ws AS ({" UNION ALL ".join(o.witness_sql(f, 24, 1) for f in motifs.FAMILIES)}) SELECT family, count(*) AS evidence, count(DISTINCT event_id) AS events FROM
  (SELECT family, event_id, witness_id FROM ws UNION ALL SELECT 'case', event_id, event_id FROM ev) JOIN (SELECT event_id FROM ev WHERE amount > 100) USING (event_id) GROUP BY family""")
def case_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_features(spark, sf_dir)
    found = motifs.case_evidence(e, e.where("amount > 100").select("event_id"), 24, 1).where("family NOT IN ('reciprocal', 'cycle3')")
    return found.groupBy("family").agg(F.count("*").alias("evidence"), F.count_distinct("event_id").alias("events"))


@query(f"""WITH {o.EVH}, {o.tri()}, rl AS ({_relay_sql("0 AND 24").split(f"WITH {o.EVH}", 1)[1]})
  SELECT (SELECT sum(n)::BIGINT FROM tri) AS raw_cycles, count(*) AS relay_pairs, count(*) FILTER (gap = 0) AS same_step, (SELECT sum(isFraud)::BIGINT FROM ev WHERE event_id IN (SELECT first_id FROM rl)) AS positive_first,
    (SELECT sum(isFraud)::BIGINT FROM ev WHERE event_id IN (SELECT second_id FROM rl)) AS positive_second FROM rl""")
def baseline_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static pattern queries side by side, labels joined after the match."""
    e = event_edges(spark, sf_dir, hourly=True)
    pairs = cut_lineage(motifs.relays(e, 10.0, 24), "relays")
    cycles = motifs.triangles(e).agg((3 * F.sum("n")).alias("raw_cycles"))
    totals = pairs.agg(F.count("*").alias("relay_pairs"), F.count_if(F.col("gap") == 0).alias("same_step"))
    sides = [e.join(pairs.select(F.col(f"{k}_id").alias("event_id")).distinct(), "event_id", "left_semi").agg(F.sum("isFraud").alias(f"positive_{k}")) for k in ("first", "second")]
    return reduce(lambda a, b: a.join(b, F.lit(True)), sides, cycles.join(totals, F.lit(True)))


@query(f"""WITH {o.EVH} SELECT count(*) AS two_hops FROM ev x JOIN ev y ON x.dst = y.src WHERE x.src <> x.dst AND y.src <> y.dst AND x.src <> y.dst AND x.type = 'TRANSFER' AND y.type = 'TRANSFER'""")
def two_hop_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hop transfer walks, counted from degrees without listing them: all walks less those that return."""
    e = event_edges(spark, sf_dir, hourly=True).where("type = 'TRANSFER' AND src <> dst")
    into, out = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i")), e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    back = motifs.reciprocal_pairs(e).agg(F.coalesce(F.sum(2 * F.col("forward") * F.col("backward")), F.lit(0)).alias("back"))
    return into.join(out, "id").agg(F.coalesce(F.sum(F.col("i") * F.col("o")), F.lit(0)).alias("walks")).join(back, F.lit(True)).select((F.col("walks") - F.col("back")).alias("two_hops"))


# --- snapshots and as-of joins -----------------------------------------------


@query(f"WITH {o.EV}, {o.CUTS} SELECT (" + " + ".join(f"(step > c{i})::INT" for i in range(5)) + ")::INT AS block, count(*) AS transactions, sum(isFraud)::BIGINT AS positives, min(step) AS min_step, max(step) AS max_step FROM ev, cuts GROUP BY 1")
def time_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    return e.groupBy(asof.block_of(asof.cutoffs(e)).alias("block")).agg(F.count("*").alias("transactions"), F.sum("isFraud").alias("positives"), F.min("step").alias("min_step"), F.max("step").alias("max_step"))


@query(f"""WITH {o.EV}, {o.CUTS} SELECT CASE WHEN step <= c1 THEN 'initial_train' WHEN step <= c2 THEN 'validation_1' WHEN step <= c3 THEN 'validation_2' WHEN step <= c4 THEN 'validation_3' ELSE 'test' END AS phase,
  count(*) AS transactions, sum(isFraud)::BIGINT AS positives, min(step) AS first_step, max(step) AS last_step, round(avg(isFraud), 9) AS positive_rate FROM ev, cuts GROUP BY 1""")
def phase_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    return rounded(asof.phase_support(e, asof.cutoffs(e)[1:]), ["positive_rate"])


_SNAP_OUT = "as_of_step, id, inDegree, outDegree, degree, round(pagerank, 6) AS pagerank, community_key, community_size, community_out_transactions, round(community_cross_fraction, 6) AS community_cross_fraction"


@query(f"WITH {o.EV}, {o.CUTS}, {o.snapshot_ctes()} SELECT {_SNAP_OUT} FROM snap")
def snapshot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_features(spark, sf_dir)
    return rounded(asof.snapshots(e, asof.cutoffs(e)), ["pagerank", "community_cross_fraction"], 6)


def _joined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int], DataFrame]:
    e = event_features(spark, sf_dir)
    cuts = asof.cutoffs(e)
    return e, cuts, asof.join_snapshots(e, cut_lineage(asof.snapshots(e, cuts), "snapshots"), cuts)


_ASOF = ["src_degree", "dst_degree", "src_seen", "dst_seen", "same_community", "community_endpoints_seen", "src_community_size", "dst_community_out_transactions"]


@query(f"WITH {o.EV}, {o.CUTS}, {o.asof_ctes()} SELECT event_id, snapshot_as_of, {', '.join(_ASOF)}, round(src_pagerank, 6) AS src_pagerank, round(dst_pagerank, 6) AS dst_pagerank FROM aj")
def asof_snapshot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_joined(spark, sf_dir)[2].select("event_id", "snapshot_as_of", *_ASOF, "src_pagerank", "dst_pagerank"), ["src_pagerank", "dst_pagerank"], 6)


@query("SELECT 0::BIGINT AS leaks")
def snapshot_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows joined to a snapshot that is not older than they are."""
    return spark.createDataFrame([(asof.future_leaks(_joined(spark, sf_dir)[2]),)], "leaks long")


_SEEN = "fs AS (SELECT id, min(step) AS f FROM (SELECT src AS id, step FROM ev UNION ALL SELECT dst, step FROM ev) GROUP BY id), hg AS (SELECT ev.*, (coalesce(s.f <= c0, FALSE))::INT AS ss, (coalesce(d.f <= c0, FALSE))::INT AS ds FROM ev JOIN fs s ON s.id = src JOIN fs d ON d.id = dst, cuts WHERE step > c0)"


@query(f"WITH {o.EV}, {o.CUTS}, {_SEEN}, x AS (SELECT count(*) AS n, sum(isFraud) AS p, count(*) FILTER (ss + ds < 2 AND isFraud = 1) AS tp, count(*) FILTER (ss + ds < 2 AND isFraud = 0) AS fp FROM hg) SELECT {o.ratios()} FROM x")
def novelty_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    later = asof.history_groups(e, asof.cutoffs(e)[0])
    hist = evaluate.score_histogram(later.withColumn("risk_score", F.when(F.col("history_group") == "both_seen", 0.0).otherwise(1.0)))
    return rounded(evaluate.metrics_at(hist, [1.0]).drop("threshold"), _RATIOS)


_RATIOS = ["precision", "recall", "f1", "prevalence", "alert_rate"]


@query(f"WITH {o.EV}, {o.CUTS}, {_SEEN} SELECT CASE ss + ds WHEN 0 THEN 'both_unseen' WHEN 1 THEN 'one_unseen' ELSE 'both_seen' END AS history_group, count(*) AS transactions, sum(isFraud)::BIGINT AS positives, round(sum(amount), 4) AS total FROM hg GROUP BY 1")
def cold_start_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    later = asof.history_groups(e, asof.cutoffs(e)[0])
    return later.groupBy("history_group").agg(F.count("*").alias("transactions"), F.sum("isFraud").alias("positives"), F.round(F.sum("amount"), 4).alias("total"))


# --- scaling, rules, evaluation ----------------------------------------------


@query(f"WITH {o.EV} SELECT payment_currency, type, quantile_disc(amount, 0.9) AS q90 FROM ev WHERE amount > 0 GROUP BY ALL")
def amount_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.amount_scales(event_edges(spark, sf_dir), exact=True)


@query(f"""WITH {o.EV}, {o.CUTS}, s AS (SELECT payment_currency, type, quantile_disc(amount, 0.9) AS q FROM ev, cuts WHERE step <= c1 AND amount > 0 GROUP BY ALL)
  SELECT event_id, round(ln(1 + least(amount / greatest(coalesce(q, 1), 1e-12), 1e12)), 9) AS scaled_amount, (q IS NULL)::INT AS unseen_amount_group, (payment_currency <> receiving_currency)::INT AS fx_payment FROM ev LEFT JOIN s USING (payment_currency, type)""")
def scaled_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    scales = models.amount_scales(e.where(F.col("step") <= asof.cutoffs(e)[1]), exact=True)
    return rounded(models.scale_amounts(e, scales).select("event_id", "scaled_amount", "unseen_amount_group", "fx_payment"), ["scaled_amount"])


_FAN_LONG = " UNION ALL ".join(f"SELECT event_id, amount, {h} AS \"window\", prior_count_{h}h AS k, witness_{h}h IS NOT NULL AS other FROM fan" for h in o.FAN_W)
_FLOORS = "fq AS (SELECT unnest([0.9, 0.95, 0.99, 0.995, 0.999])::DOUBLE AS quantile, unnest([" + ", ".join(f"quantile_disc(amount, {q})" for q in (0.9, 0.95, 0.99, 0.995, 0.999)) + "]) AS floor FROM ev, tc WHERE type = 'CASH_OUT' AND amount > 0 AND step <= t0), fl AS (SELECT 0.0::DOUBLE AS quantile, 0.0::DOUBLE AS floor UNION ALL SELECT * FROM fq)"
_MEASURES = ["precision", "recall", "f1"]


def _validation(e: DataFrame) -> tuple[int, DataFrame]:
    """(end of training, truth of the validation rows)."""
    train, validation = asof.cutoffs(e, asof.SPLIT_FRACTIONS)
    return train, e.where((F.col("step") > train) & (F.col("step") <= validation)).select("event_id", "isFraud")


@query(f"WITH {o.EVH}, {o.SPLIT}, {o.fanin_ctes()}, {_FLOORS}, long AS ({_FAN_LONG}), pr AS (SELECT unnest([1, 2, 5])::INT AS min_prior), "
  + o.judged('family, "window", min_prior, quantile, floor', """SELECT 'fanin' AS family, l."window", min_prior, quantile, floor, isFraud, other AND k >= min_prior AND amount > floor AS hit FROM long l JOIN va USING (event_id), pr, fl
    UNION ALL SELECT 'amount_only', 0, 0, quantile, floor, isFraud, amount > floor FROM fan JOIN va USING (event_id), fl"""))
def fanin_rule_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir, hourly=True)
    train, truth = _validation(e)
    features = e.drop("isFraud")
    return rounded(rules.fanin_grid(motifs.fanin_features(features), truth, rules.fanin_floors(features, train)), _MEASURES)


@query(f"""WITH {o.EVH}, {o.fanin_ctes()} SELECT event_id FROM fan WHERE witness_24h IS NOT NULL AND prior_count_24h >= 2 AND amount > 40""")
def fanin_rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.fanin_alerts(motifs.fanin_features(event_features(spark, sf_dir, hourly=True)), "fanin", 24, 2, 40.0)


_CYCLE_FLOORS = "cq AS (SELECT payment_currency, unnest([0.5, 0.9])::DOUBLE AS quantile, unnest([quantile_disc(amount, 0.5), quantile_disc(amount, 0.9)]) AS floor FROM ev, tc WHERE step <= t0 AND amount > 0 GROUP BY payment_currency), cf AS (SELECT * FROM cq UNION ALL SELECT DISTINCT payment_currency, 0.0::DOUBLE, 0.0::DOUBLE FROM ev)"


@query(f"WITH {o.EV}, {o.ELIG}, {o.SPLIT}, {o.cycles_sql(504)}, {_CYCLE_FLOORS}, g AS (SELECT * FROM (SELECT unnest([1, 6, 24, 72, 168, 504])::INT AS hours), (SELECT unnest([0.0, 0.5, 0.8, 0.95])::DOUBLE AS ratio)), "
  + o.judged("hours, ratio, quantile", """SELECT hours, ratio, quantile, event_id, any_value(isFraud) AS isFraud, bool_or(gap_seconds <= hours * 3600 AND amount_ratio >= ratio AND minimum_cycle_amount > floor) AS hit
    FROM cyc JOIN va USING (event_id) JOIN cf USING (payment_currency), g GROUP BY hours, ratio, quantile, event_id"""))
def cycle_rule_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    train, truth = _validation(e)
    features = e.drop("isFraud")
    cycles = cut_lineage(motifs.temporal_cycles(features, 504, 1), "cycles")
    return rounded(rules.cycle_grid(cycles, truth, rules.cycle_floors(features, train)), _MEASURES)


_TAIL_CASES = " UNION ALL ".join(
    [f"SELECT '{n}_{'low' if q < 0.5 else 'high'}' AS family, {q}::DOUBLE AS tail, quantile_disc({n}, {q})::DOUBLE AS cut, '{n}' AS feature FROM one" for names in rules.BRANCHES.values() for n in names for q in rules.COMPONENT_TAILS]
    + ["SELECT 'novelty', 1.0::DOUBLE, 1.0::DOUBLE, 'novelty'"]
)
_SCORES = " UNION ALL ".join([f"SELECT event_id, '{n}' AS feature, greatest(src_{n}, dst_{n})::DOUBLE AS score FROM jo" for names in rules.BRANCHES.values() for n in names] + ["SELECT event_id, 'novelty', (src_seen = 0 OR dst_seen = 0)::INT::DOUBLE FROM jo"])


@query(f"""WITH {o.EV}, {o.CUTS}, {o.snapshot_ctes()}, one AS (SELECT * REPLACE (round(pagerank, 6) AS pagerank, round(community_cross_fraction, 6) AS community_cross_fraction) FROM snap WHERE as_of_step = (SELECT c1 FROM cuts)),
  jo AS (SELECT ev.event_id, {', '.join(f"coalesce({s}.{n}, 0) AS {side}_{n}" for side, s in (("src", "s"), ("dst", "d")) for names in rules.BRANCHES.values() for n in names)}, (s.id IS NOT NULL)::INT AS src_seen, (d.id IS NOT NULL)::INT AS dst_seen
    FROM ev LEFT JOIN one s ON s.id = src LEFT JOIN one d ON d.id = dst, cuts WHERE step > c1 AND step <= c2),
  va AS (SELECT event_id, isFraud FROM ev, cuts WHERE step > c1 AND step <= c2), su AS (SELECT count(*) AS n, sum(isFraud) AS p FROM va), ru AS ({_TAIL_CASES}), sc AS ({_SCORES}), """
  + o.judged("family, tail, cut", "SELECT family, tail, cut, isFraud, CASE WHEN family LIKE '%_low' THEN score <= cut ELSE score >= cut END AS hit FROM ru JOIN sc USING (feature) JOIN va USING (event_id)"))
def component_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    cuts = asof.cutoffs(e)
    features = e.drop("isFraud")
    snap = cut_lineage(rounded(asof.snapshots(features, cuts[1:2]), ["pagerank", "community_cross_fraction"], 6), "snapshot")
    later = (F.col("step") > cuts[1]) & (F.col("step") <= cuts[2])
    scored = rules.component_features(asof.join_snapshots(features.where(later), snap, cuts[1:2]))
    return rounded(rules.component_grid(scored, e.where(later), rules.component_rules(snap)), _MEASURES)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.least(F.lit(1.0), F.floor(F.col("amount") / 25) * 0.1 + F.when(F.col("type") == "TRANSFER", 0.05).otherwise(0.0))
    return event_edges(spark, sf_dir).withColumn("risk_score", F.round(score, 6))


@query(f'WITH {o.EV}, {o.HIST} SELECT risk_score, isFraud, n AS "count" FROM hist')
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_histogram(_scored(spark, sf_dir))


@query(f"""WITH {o.EV}, {o.HIST}, l AS (SELECT risk_score, sum(n) FILTER (isFraud = 1) AS pos, sum(n) AS n FROM hist GROUP BY 1), c AS (SELECT risk_score AS threshold, coalesce(pos, 0) AS pos,
    sum(coalesce(pos, 0)) OVER (ORDER BY risk_score DESC) AS tp, sum(n) OVER (ORDER BY risk_score DESC) AS seen, sum(coalesce(pos, 0)) OVER () AS p FROM l)
  SELECT threshold, tp::BIGINT AS tp, (seen - tp)::BIGINT AS fp, round(tp / seen, 9) AS precision, round(tp / nullif(p, 0), 9) AS recall, pos::BIGINT AS level_positives FROM c""")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.pr_curve(score_histogram(spark, sf_dir)), ["precision", "recall"])


@query(f"""WITH {o.EV}, {o.HIST}, l AS (SELECT risk_score, coalesce(sum(n) FILTER (isFraud = 1), 0) AS pos, sum(n) AS n FROM hist GROUP BY 1),
  c AS (SELECT pos, sum(pos) OVER (ORDER BY risk_score DESC) / sum(n) OVER (ORDER BY risk_score DESC) AS pr, sum(pos) OVER () AS p FROM l) SELECT round(sum(pr * pos) / nullif(max(p), 0), 9) AS average_precision FROM c""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.average_precision(evaluate.pr_curve(score_histogram(spark, sf_dir))), ["average_precision"])


_CONF = f"t AS (SELECT threshold::DOUBLE AS threshold, sum(n) AS n, sum(n) FILTER (isFraud = 1) AS p, coalesce(sum(n) FILTER (risk_score >= threshold AND isFraud = 1), 0) AS tp, coalesce(sum(n) FILTER (risk_score >= threshold AND isFraud = 0), 0) AS fp FROM hist, {o.TH} GROUP BY 1)"


@query(f"WITH {o.EV}, {o.HIST}, {_CONF} SELECT threshold, {o.ratios()} FROM t")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.metrics_at(score_histogram(spark, sf_dir), evaluate.THRESHOLDS), _RATIOS)


@query(f"""WITH {o.EV} , s AS (SELECT type, sum(isFraud) AS k, count(*)::DOUBLE AS n FROM ev GROUP BY type), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM s)
  SELECT type, round(greatest((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 0), 9) AS low, round(least((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 1), 9) AS high FROM z""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = event_edges(spark, sf_dir).groupBy("type").agg(F.sum("isFraud").alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return sums.select("type", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_FOLDS = [(1, 2), (2, 3), (3, 4)]  # validation blocks between the cutoffs .4 .5 .65 .8
_FOLD_CASE = "CASE " + " ".join(f"WHEN step > c{a} AND step <= c{b} THEN {i}" for i, (a, b) in enumerate(_FOLDS)) + " END"


_BOARD = f"""WITH {o.EV}, {o.CUTS}, {o.HIST}, f AS (SELECT {_FOLD_CASE} AS fold, risk_score, isFraud FROM sc, cuts WHERE step > c1 AND step <= c4),
  m AS (SELECT fold, threshold::DOUBLE AS threshold, count(*) AS n, count(*) FILTER (isFraud = 1) AS p, count(*) FILTER (risk_score >= threshold AND isFraud = 1) AS tp, count(*) FILTER (risk_score >= threshold AND isFraud = 0) AS fp FROM f, {o.TH} GROUP BY ALL),
  x AS (SELECT *, 2 * tp / nullif(tp + fp + p, 0) AS f1, tp / nullif(tp + fp, 0) AS pr FROM m),
  lb AS (SELECT 'rule' AS family, threshold, round(avg(f1), 9) AS mean_f1, round(min(f1), 9) AS worst_f1, round(stddev_samp(f1), 9) AS std_f1, round(avg(pr), 9) AS mean_precision, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp,
    sum(p - tp)::BIGINT AS fn, sum(n)::BIGINT AS transactions, count(*) AS folds, 0::INT AS complexity FROM x GROUP BY threshold)"""


@query(_BOARD + " SELECT * FROM lb")
def walk_forward_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    cuts = asof.cutoffs(scored)
    fold = F.when(F.col("step") <= cuts[2], 0).when(F.col("step") <= cuts[3], 1).otherwise(2)
    rows = scored.where((F.col("step") > cuts[1]) & (F.col("step") <= cuts[4])).select(fold.alias("fold"), F.lit("rule").alias("family"), "risk_score", "isFraud")
    folds = evaluate.metrics_at(evaluate.score_histogram(rows, ["fold", "family"]), evaluate.THRESHOLDS, ["fold", "family"])
    return rounded(evaluate.leaderboard(folds, 3), ["mean_f1", "worst_f1", "std_f1", "mean_precision"])


@query(_BOARD + " SELECT family, threshold, mean_f1, worst_f1, tp, fp FROM lb ORDER BY mean_f1 DESC, worst_f1 DESC, fp, complexity, threshold DESC LIMIT 1")
def selected_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.select_rule(walk_forward_leaderboard(spark, sf_dir)).select("family", "threshold", "mean_f1", "worst_f1", "tp", "fp")


@query(f"""WITH {o.EV}, {o.HIST}, r AS (SELECT isFraud, row_number() OVER (ORDER BY risk_score DESC, {o.KEY}, event_id) AS rk FROM sc), t AS (SELECT count(*) AS n, sum(isFraud) AS p FROM sc),
  b AS (SELECT f::DOUBLE AS fraction, greatest(1, least(n, ceil(n * f::DOUBLE)))::BIGINT AS k, n AS transactions, p::BIGINT AS positives FROM (SELECT unnest([0.001, 0.005, 0.01]) AS f), t)
  SELECT fraction, k, transactions, positives, sum(isFraud)::BIGINT AS reviewed_positives, round(sum(isFraud) / k, 9) AS precision, round(sum(isFraud) / nullif(positives, 0), 9) AS recall FROM b JOIN r ON rk <= k GROUP BY fraction, k, transactions, positives""")
def review_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    keyed = clean.normalize_edges(scored).select("event_id", "event_key").join(scored.select("event_id", "risk_score", "isFraud"), "event_id")
    return rounded(evaluate.review_budgets(keyed), ["precision", "recall"])


_PERIOD = "CASE " + " ".join(f"WHEN step <= p{i} THEN {i}" for i in range(4)) + " ELSE 4 END"
_TEST_BASE = f"tq AS (SELECT {', '.join(f'quantile_disc(step, {f}) AS p{i}' for i, f in enumerate((0.2, 0.4, 0.6, 0.8)))} FROM ev, cuts WHERE step > c4), pd AS (SELECT {_PERIOD} AS period, amount, isFraud, type FROM ev, cuts, tq WHERE step > c4)"
#: Stand-in scores of the model families, expressible on both sides, with their thresholds.
_MODEL_SCORES = {family: f"round(least(1.0, floor(amount / {12 + 4 * i}) * 0.1 + CASE WHEN type = 'TRANSFER' THEN 0.05 ELSE 0.0 END), 6)" for i, family in enumerate(models.FAMILIES)}
_THRESHOLDS = {family: round(0.3 + 0.1 * (i % 3), 1) for i, family in enumerate(models.FAMILIES)}


def _stability_sql(group: str, select: str) -> str:
    """Measures per model and group at the model's threshold, with average precision and Wilson bounds, as ``m``."""
    rows = " UNION ALL ".join(f"SELECT '{m}' AS model, {_THRESHOLDS[m]}::DOUBLE AS threshold, {group} AS period, ({c})::DOUBLE AS score, isFraud FROM pd" for m, c in _MODEL_SCORES.items())

    def bound(a: str, b: str, sign: str, edge: str) -> str:
        p, z = f"({a} / ({b})::DOUBLE)", "1.959963984540054"
        middle, half = f"({p} + {z}*{z}/(2*({b}))) / (1 + {z}*{z}/({b}))", f"{z} * sqrt({p}*(1-{p})/({b}) + {z}*{z}/(4.0*({b})*({b}))) / (1 + {z}*{z}/({b}))"
        return f"CASE WHEN ({b}) > 0 THEN round({'greatest' if sign == '-' else 'least'}({middle} {sign} {half}, {edge}), 9) END"

    return f"""WITH {o.EV}, {o.CUTS}, {_TEST_BASE}, sr AS ({rows}),
  lv AS (SELECT model, period, score, sum(isFraud) AS pos, count(*) AS n FROM sr GROUP BY ALL),
  cu AS (SELECT *, sum(pos) OVER w / sum(n) OVER w AS pr FROM lv WINDOW w AS (PARTITION BY model, period ORDER BY score DESC)),
  ap AS (SELECT model, period, round(sum(pr * pos) / nullif(sum(pos), 0), 9) AS average_precision FROM cu GROUP BY ALL),
  ct AS (SELECT model, period, threshold, count(*) AS n, sum(isFraud)::BIGINT AS p, count(*) FILTER (score >= threshold AND isFraud = 1) AS tp, count(*) FILTER (score >= threshold AND isFraud = 0) AS fp FROM sr GROUP BY ALL),
  m AS (SELECT model, period, threshold, {o.ratios()}, {bound("tp", "tp + fp", "-", "0")} AS precision_low, {bound("tp", "tp + fp", "+", "1")} AS precision_high,
    {bound("tp", "p", "-", "0")} AS recall_low, {bound("tp", "p", "+", "1")} AS recall_high, average_precision FROM ct JOIN ap USING (model, period)) {select}"""


_BOUNDS = ["precision_low", "precision_high", "recall_low", "recall_high", "average_precision"]


def _stability(spark: SparkSession, sf_dir: str, by_period: bool) -> DataFrame:
    e = event_edges(spark, sf_dir)
    test = e.where(F.col("step") > asof.cutoffs(e)[4])
    period = asof.block_of(asof.cutoffs(test, (0.2, 0.4, 0.6, 0.8))) if by_period else F.lit(0)
    scores = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(c).cast("double").alias("risk_score")) for m, c in _MODEL_SCORES.items()])
    rows = test.select(period.alias("period"), "isFraud", F.inline(scores))
    histogram = evaluate.score_histogram(rows, ["model", "period"])
    return rounded(evaluate.stability(cut_lineage(histogram, "histogram"), _THRESHOLDS), [*_RATIOS, *_BOUNDS])


@query(_stability_sql("period", "SELECT * FROM m"))
def temporal_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stability(spark, sf_dir, True)


@query(_stability_sql("period", """SELECT model, round(avg(f1), 6) AS mean_f1, round(min(f1), 6) AS min_f1, round(max(f1), 6) AS max_f1, round(stddev_samp(f1), 6) AS std_f1, round(min(precision), 6) AS min_precision,
  round(max(precision), 6) AS max_precision, count(*) AS periods, count(*) FILTER (tp + fn > 0) AS positive_periods FROM m GROUP BY model"""))
def temporal_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.reliability(_stability(spark, sf_dir, True)), ["mean_f1", "min_f1", "max_f1", "std_f1", "min_precision", "max_precision"], 6)


_PAIRS = ", ".join(f"('{c}', '{a}', '{b}')" for c, a, b in evaluate.CONTRASTS)


@query(_stability_sql("0", f"""SELECT contrast, enhanced, reference, {', '.join(f"round(a.{c} - b.{c}, 6) AS delta_{c}" for c in ("precision", "recall", "f1", "average_precision"))}
  FROM (VALUES {_PAIRS}) AS v(contrast, enhanced, reference) JOIN m a ON a.model = enhanced JOIN m b ON b.model = reference"""))
def ablation_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.contrasts(_stability(spark, sf_dir, False)), [f"delta_{c}" for c in ("precision", "recall", "f1", "average_precision")], 6)


@query(f"WITH {o.EV}, {o.CUTS}, {o.HIST} SELECT payment_currency, CASE WHEN risk_score >= 0.3 THEN CASE WHEN isFraud = 1 THEN 'TP' ELSE 'FP' END ELSE CASE WHEN isFraud = 1 THEN 'FN' ELSE 'TN' END END AS \"case\", count(*) AS transactions, round(sum(amount), 4) AS payment_amount FROM sc GROUP BY ALL")
def amounts_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    alert, y = F.col("risk_score") >= 0.3, F.col("isFraud") == 1
    case = F.when(alert & y, "TP").when(alert, "FP").when(y, "FN").otherwise("TN")
    return _scored(spark, sf_dir).groupBy("payment_currency", case.alias("case")).agg(F.count("*").alias("transactions"), F.round(F.sum("amount"), 4).alias("payment_amount"))


@query(f"""WITH {o.EV}, {o.HIST}, c AS (SELECT event_id, risk_score, isFraud, CASE WHEN risk_score >= 0.3 THEN CASE WHEN isFraud = 1 THEN 'TP' ELSE 'FP' END WHEN isFraud = 1 THEN 'FN' END AS "case" FROM sc)
  SELECT event_id, risk_score, isFraud, "case", row_number() OVER (PARTITION BY "case" ORDER BY risk_score DESC, event_id)::INT AS "rank" FROM c WHERE "case" IS NOT NULL QUALIFY "rank" <= 5""")
def example_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("event_id", "risk_score", "isFraud", (F.col("risk_score") >= 0.3).alias("alert"))
    return evaluate.examples(rows).drop("alert")


@query(f"""WITH {o.EV}, {o.CUTS}, a AS (SELECT DISTINCT event_id FROM ev WHERE type = 'TRANSFER' AND amount > 60),
  t AS (SELECT CASE WHEN step <= c1 THEN 'train' WHEN step <= c4 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, sum(isFraud) AS p, count(*) FILTER (a.event_id IS NOT NULL AND isFraud = 1) AS tp, count(*) FILTER (a.event_id IS NOT NULL AND isFraud = 0) AS fp
    FROM ev LEFT JOIN a USING (event_id), cuts GROUP BY 1) SELECT split, {o.ratios()} FROM t""")
def alert_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    cuts = asof.cutoffs(e)
    alerts = e.where("type = 'TRANSFER' AND amount > 60").select("event_id")
    return rounded(evaluate.alert_evaluation(alerts, e.withColumn("split", asof.split_of([cuts[1], cuts[4]]))), _RATIOS)


def _tree_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """All features of every transaction; the label is joined last."""
    e, cuts, joined = _joined(spark, sf_dir)
    featured = joined.join(motifs.motif_features(e, W, 1), "event_id")
    return cut_lineage(featured.join(event_edges(spark, sf_dir).select("event_id", "isFraud"), "event_id"), "features"), cuts


@query(f"WITH {o.EV}, {o.CUTS} SELECT count(*) AS rows, 0::BIGINT AS mismatches FROM ev, cuts WHERE step > c4")
def model_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen predictions of a saved tree against those of the model in memory."""
    rows, cuts = _tree_rows(spark, sf_dir)
    model = models.fit(rows.where(F.col("step") <= cuts[4]), "transaction_only")
    folder = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    models.save(model, folder)
    test = rows.where(F.col("step") > cuts[4]).drop("isFraud")
    return models.replay_faults(models.score(model, test).select("event_id", "risk_score"), models.frozen_prediction(spark, folder, test, 0.5))


@query()
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cuts = _tree_rows(spark, sf_dir)
    model = models.fit(rows.where(F.col("step") <= cuts[4]), "full_fusion")
    return models.score(model, rows.where(F.col("step") > cuts[4])).select("event_id", "step", "isFraud", F.round("risk_score", 9).alias("risk_score"))


@query()
def tree_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cuts = _tree_rows(spark, sf_dir)
    fitted = models.fit_families(rows.where(F.col("step") <= cuts[4]), list(models.FAMILIES))
    out = [(family, name, value) for family, model in fitted.items() for name, value in model.importance()]
    return spark.createDataFrame(out, "family string, feature string, importance double")


@query()
def walk_forward_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families over the three folds: metrics per fold, family and threshold."""
    rows, cuts = _tree_rows(spark, sf_dir)
    found = []
    for fold, (a, b) in enumerate(_FOLDS):
        fitted = models.fit_families(rows.where(F.col("step") <= cuts[a]), list(models.FAMILIES))
        scored = models.score_families(fitted, rows.where((F.col("step") > cuts[a]) & (F.col("step") <= cuts[b])))
        found.append(cut_lineage(evaluate.score_histogram(scored.select("risk_score", "isFraud", F.lit(fold).alias("fold"), "family"), ["fold", "family"]), "histogram"))
    return evaluate.metrics_at(motifs.union_all(found), evaluate.THRESHOLDS, ["fold", "family"])


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the causal motif features of every transaction."""
    return motif_features(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "entry_query", "tables"]
