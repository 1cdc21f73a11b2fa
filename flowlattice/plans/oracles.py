"""DuckDB SQL for the catalogue: the plain definitions, written without our plan shapes."""

from __future__ import annotations

_CUR = "['USD','EUR','GBP']"


def events_cte(hourly: bool = False) -> str:
    step = "CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 + 1" if hourly else "CAST(floor(epoch(ts)) AS BIGINT)"
    return f"""ev AS (
  SELECT event_id, 'A' || user_id AS src, 'A' || json_extract_string(props, '$.k') AS dst, {step} AS step, value AS amount,
         CASE event_type WHEN 'purchase' THEN 'TRANSFER' WHEN 'click' THEN 'CASH_OUT' WHEN 'view' THEN 'PAYMENT' WHEN 'signup' THEN 'CASH_IN' WHEN 'error' THEN 'DEBIT' END AS type,
         {_CUR}[event_id % 3 + 1] AS payment_currency,
         CASE WHEN event_id % 10 = 0 THEN {_CUR}[(event_id + 1) % 3 + 1] ELSE {_CUR}[event_id % 3 + 1] END AS receiving_currency,
         CASE WHEN value > 120 AND event_id % 3 = 0 THEN 1 ELSE 0 END AS isFraud
  FROM events)"""


EV, EVH = events_cte(), events_cte(True)
IDS = "ids AS (SELECT src AS id FROM ev UNION SELECT dst FROM ev)"
ELIG = "el AS (SELECT * FROM ev WHERE src <> dst AND amount > 0 AND payment_currency = receiving_currency)"
TRADE = """tr AS (
  SELECT l_orderkey * 10 + l_linenumber AS edge_id, 'C' || o_custkey AS src, 'M' || l_suppkey AS dst,
         date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::BIGINT AS step, l_extendedprice AS amount, l_returnflag AS type,
         CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END AS isFraud
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
TV = """tv AS (
  SELECT 'C' || c_custkey AS id, 'Customer' AS account_type, c_acctbal AS balance, CAST(c_nationkey AS VARCHAR) AS bank_id FROM customer
  UNION ALL SELECT 'M' || s_suppkey, 'Merchant', s_acctbal, CAST(s_nationkey AS VARCHAR) FROM supplier)"""
KEY = """sha256('{"amount":' || amount || ',"dst":"' || dst || '","payment_currency":"' || payment_currency || '","receiving_currency":"' || receiving_currency
  || '","src":"' || src || '","step":' || step || ',"type":"' || type || '"}')"""
#: The event rows with most receivers moved into the sender's eighth of the accounts.
EVC = EV.replace("ev AS (", "ev_raw AS (", 1) + """, ev AS (SELECT * REPLACE (CASE WHEN event_id % 20 = 0 THEN dst ELSE
  'A' || (CAST(floor(CAST(substr(dst, 2) AS BIGINT) / 8) AS BIGINT) * 8 + CAST(substr(src, 2) AS BIGINT) % 8) END AS dst) FROM ev_raw)"""
MULT = "mult AS (SELECT src, dst, count(*) AS n FROM ev GROUP BY ALL)"
TRI = """pairs AS (SELECT src, dst, count(*) AS n FROM {base} WHERE src <> dst GROUP BY ALL),
  tri AS (SELECT x.src AS a, y.src AS b, z.src AS c, (x.n * y.n * z.n)::BIGINT AS n FROM pairs x JOIN pairs y ON x.dst = y.src JOIN pairs z ON y.dst = z.src AND z.dst = x.src
          WHERE x.src <> y.src AND y.src <> z.src AND x.src <> z.src)"""


def tri(base: str = "ev") -> str:
    return TRI.format(base=base)


def pagerank_ctes(edges: str = "ev", iterations: int = 10) -> str:
    """Unrolled power iteration over ids/weights of one graph."""
    parts = [
        f"pr_v AS MATERIALIZED (SELECT src AS id FROM {edges} UNION SELECT dst FROM {edges})",
        f"pr_w AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM (SELECT src, dst, count(*) AS n FROM {edges} GROUP BY ALL))",
        "pr_0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS r FROM pr_v)",
    ]
    for k in range(iterations):
        parts.append(
            f"pr_{k + 1} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(s.r, 0) AS r FROM pr_v v LEFT JOIN "
            f"(SELECT dst AS id, sum(r * w) AS r FROM pr_{k} JOIN pr_w ON id = src GROUP BY 1) s USING (id))"
        )
    parts.append(f"pr AS (SELECT id, r * count(*) OVER () / sum(r) OVER () AS pagerank FROM pr_{iterations})")
    return ",\n".join(parts)


def lpa_ctes(edges: str = "ev", iterations: int = 5, name: str = "lp") -> str:
    """Unrolled synchronous label propagation."""
    parts = [
        f"{name}_v AS MATERIALIZED (SELECT src AS id FROM {edges} UNION SELECT dst FROM {edges})",
        f"{name}_l AS MATERIALIZED (SELECT id, other, count(*) AS n FROM (SELECT src AS id, dst AS other FROM {edges} UNION ALL SELECT dst, src FROM {edges}) GROUP BY ALL)",
        f"{name}_0 AS MATERIALIZED (SELECT id, CAST(substr(id, 2) AS BIGINT) AS label FROM {name}_v)",
    ]
    for k in range(iterations):
        parts.append(
            f"{name}_{k + 1} AS MATERIALIZED (SELECT v.id, coalesce(w.label, p.label) AS label FROM {name}_v v JOIN {name}_{k} p USING (id) LEFT JOIN "
            f"(SELECT id, label FROM (SELECT l.id, q.label, sum(l.n) AS votes FROM {name}_l l JOIN {name}_{k} q ON l.other = q.id GROUP BY ALL) "
            f"QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) = 1) w USING (id))"
        )
    parts.append(f"{name} AS (SELECT * FROM {name}_{iterations})")
    return ",\n".join(parts)


def _past(condition: str, account: str, width: int) -> str:
    return f"(SELECT count(*) FROM el p WHERE {condition} AND p.payment_currency = e.payment_currency AND e.step - p.step BETWEEN 1 AND {width})"


def star_sql(hourly: bool, windows: tuple[int, ...]) -> str:
    """Counts by RANGE frames over role rows (the naive bounded frames)."""
    per = 3600 if hourly else 1
    typed = "p_in AND type = 'TRANSFER'" if hourly else "p_in"
    closes = "NOT p_in AND type = 'CASH_OUT'" if hourly else "NOT p_in"
    frames = ", ".join(f"w{h} AS (PARTITION BY account, payment_currency ORDER BY step RANGE BETWEEN {h * 3600 // per} PRECEDING AND 1 PRECEDING)" for h in windows)
    counts = ", ".join(f"count(*) FILTER (p_in) OVER w{h} AS i{h}, count(*) FILTER (NOT p_in) OVER w{h} AS o{h}, count(*) FILTER ({typed}) OVER w{h} AS t{h}" for h in windows)
    out = ", ".join(
        f"max(i{h}) FILTER (NOT p_in) AS sender_in_{h}h, max(o{h}) FILTER (NOT p_in) AS sender_out_{h}h, max(i{h}) FILTER (p_in) AS receiver_in_{h}h, "
        f"max(o{h}) FILTER (p_in) AS receiver_out_{h}h, coalesce(max(t{h}) FILTER ({closes}), 0) AS typed_in_{h}h"
        for h in windows
    )
    return f"""role AS (SELECT *, src AS account, FALSE AS p_in FROM el UNION ALL SELECT *, dst, TRUE FROM el),
  rc AS (SELECT event_id, type, p_in, {counts} FROM role WINDOW {frames}),
  star AS (SELECT event_id, {out} FROM rc GROUP BY event_id)"""


def pair_sql(hourly: bool, windows: tuple[int, ...]) -> str:
    """Same-partner and reverse counts by correlated frames over unordered pairs."""
    per = 3600 if hourly else 1
    typed = "type = 'TRANSFER'" if hourly else "TRUE"
    closes = "type = 'CASH_OUT'" if hourly else "TRUE"
    frames = ", ".join(f"w{h} AS (PARTITION BY lo, hi, payment_currency ORDER BY step RANGE BETWEEN {h * 3600 // per} PRECEDING AND 1 PRECEDING)" for h in windows)
    cols, out = [], []
    for h in windows:
        cols += [f"count(*) FILTER (up) OVER w{h} AS u{h}", f"count(*) FILTER (NOT up) OVER w{h} AS d{h}", f"count(*) FILTER (up AND {typed}) OVER w{h} AS tu{h}", f"count(*) FILTER (NOT up AND {typed}) OVER w{h} AS td{h}",
                 f"max(CASE WHEN up THEN {{'s': step, 'e': event_id}} END) OVER w{h} AS xu{h}", f"max(CASE WHEN NOT up THEN {{'s': step, 'e': event_id}} END) OVER w{h} AS xd{h}"]
        out += [f"CASE WHEN up THEN u{h} ELSE d{h} END AS same_partner_{h}h", f"CASE WHEN up THEN d{h} ELSE u{h} END AS reciprocal_{h}h",
                f"CASE WHEN {closes} THEN CASE WHEN up THEN td{h} ELSE tu{h} END ELSE 0 END AS reverse_typed_{h}h", f"CASE WHEN up THEN xd{h}.e ELSE xu{h}.e END AS reciprocal_witness_{h}h"]
    return f"""pr0 AS (SELECT *, least(src, dst) AS lo, greatest(src, dst) AS hi, src < dst AS up FROM el),
  prw AS (SELECT event_id, type, up, {", ".join(cols)} FROM pr0 WINDOW {frames}),
  pair AS (SELECT event_id, {", ".join(out)} FROM prw)"""


def cycles_sql(hours: int, per: int = 1) -> str:
    w = hours * 3600 // per
    return f"""cyc AS (SELECT z.event_id, x.event_id AS first_id, y.event_id AS second_id, x.src AS a, y.src AS b, z.src AS c, x.payment_currency,
    (z.step - x.step) * {per} AS gap_seconds, least(x.amount, y.amount, z.amount) AS minimum_cycle_amount,
    least(x.amount, y.amount, z.amount) / greatest(x.amount, y.amount, z.amount) AS amount_ratio
  FROM el x JOIN el y ON x.dst = y.src AND x.payment_currency = y.payment_currency AND x.step < y.step AND y.step - x.step <= {w}
  JOIN el z ON y.dst = z.src AND z.dst = x.src AND z.payment_currency = x.payment_currency AND y.step < z.step AND z.step - x.step <= {w}
  WHERE x.src <> y.dst)"""


CYF = """cyf AS (SELECT event_id, count(*) AS cycle3_count, max(amount_ratio) AS cycle3_best_ratio, min(gap_seconds) AS cycle3_min_gap, min({'f': first_id, 's': second_id}) AS w
  FROM cyc GROUP BY event_id)"""


def motif_sql(windows: tuple[int, ...] = (24, 168), hourly: bool = False) -> str:
    """The combined feature table ``mf``."""
    out = []
    for h in windows:
        out += [f"coalesce({c}_{h}h, 0)::BIGINT AS {c}_{h}h" for c in ("sender_in", "sender_out", "receiver_in", "receiver_out")]
        out += [
            f"greatest(coalesce(receiver_in_{h}h, 0) - coalesce(same_partner_{h}h, 0), 0)::BIGINT AS fanin_{h}h",
            f"greatest(coalesce(sender_out_{h}h, 0) - coalesce(same_partner_{h}h, 0), 0)::BIGINT AS fanout_{h}h",
            f"greatest(coalesce(typed_in_{h}h, 0) - coalesce(reverse_typed_{h}h, 0), 0)::BIGINT AS relay_{h}h",
            f"coalesce(reciprocal_{h}h, 0)::BIGINT AS reciprocal_{h}h",
            f"reciprocal_witness_{h}h",
        ]
    return f"""{star_sql(hourly, windows)}, {pair_sql(hourly, windows)}, {cycles_sql(max(windows), 3600 if hourly else 1)}, {CYF},
  mf AS (SELECT event_id, {", ".join(out)}, coalesce(cycle3_count, 0)::BIGINT AS cycle3_count, coalesce(cycle3_best_ratio, 0.0) AS cycle3_best_ratio,
    coalesce(cycle3_min_gap, 0)::BIGINT AS cycle3_min_gap, w.f AS witness_first, w.s AS witness_second
  FROM ev LEFT JOIN star USING (event_id) LEFT JOIN pair USING (event_id) LEFT JOIN cyf USING (event_id))"""


CUTS = "cuts AS MATERIALIZED (SELECT " + ", ".join(f"quantile_disc(step, {f}) AS c{i}" for i, f in enumerate((0.2, 0.4, 0.5, 0.65, 0.8))) + " FROM ev)"
SNAP = ["inDegree", "outDegree", "degree", "pagerank", "community_size", "community_out_transactions", "community_cross_fraction"]


def snapshot_ctes() -> str:
    """Per cutoff its own graph, ranks, labels and profile, then their union ``snap``."""
    parts = []
    for i in range(5):
        e = f"se{i}"
        parts.append(f"{e} AS MATERIALIZED (SELECT src, dst FROM ev, cuts WHERE step <= c{i})")
        parts.append(pagerank_ctes(e).replace("pr_", f"pr{i}_").replace("pr AS (", f"pr{i} AS (").replace("sum(r * w)", "sum(r * w)"))
        parts.append(lpa_ctes(e, name=f"lp{i}"))
        parts.append(
            f"sn{i} AS (SELECT c{i}::BIGINT AS as_of_step, d.id, d.i::BIGINT AS inDegree, d.o::BIGINT AS outDegree, (d.i + d.o)::BIGINT AS degree, p.pagerank, k.key AS community_key, k.n AS community_size, "
            f"coalesce(t.n, 0) AS community_out_transactions, coalesce(t.x, 0.0) AS community_cross_fraction "
            f"FROM (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT src AS id, 0 AS i, 1 AS o FROM {e} UNION ALL SELECT dst, 1, 0 FROM {e}) GROUP BY id) d JOIN pr{i} p USING (id) JOIN lp{i} l USING (id) "
            f"JOIN (SELECT label, min(id) AS key, count(*) AS n FROM lp{i} GROUP BY label) k USING (label) "
            f"LEFT JOIN (SELECT s.label, count(*) AS n, avg(CASE WHEN s.label <> q.label THEN 1.0 ELSE 0.0 END) AS x FROM {e} JOIN lp{i} s ON s.id = src JOIN lp{i} q ON q.id = dst GROUP BY s.label) t USING (label), cuts)"
        )
    parts.append("snap AS (" + " UNION ALL ".join(f"SELECT * FROM sn{i}" for i in range(5)) + ")")
    return ",\n".join(parts)


AS_OF = "CASE " + " ".join(f"WHEN step > c{i} THEN c{i}" for i in reversed(range(5))) + " END"


def asof_ctes() -> str:
    cols = ", ".join([f"coalesce({s}.{c}, 0) AS {side}_{c}" for side, s in (("src", "s"), ("dst", "d")) for c in SNAP])
    return f"""{snapshot_ctes()},
  aj AS (SELECT e.*, {cols}, (s.id IS NOT NULL)::INT AS src_seen, (d.id IS NOT NULL)::INT AS dst_seen, coalesce(s.community_key = d.community_key, FALSE)::INT AS same_community,
    (s.id IS NOT NULL AND d.id IS NOT NULL)::INT AS community_endpoints_seen
  FROM (SELECT ev.*, ({AS_OF})::BIGINT AS snapshot_as_of FROM ev, cuts) e
  LEFT JOIN snap s ON s.as_of_step = e.snapshot_as_of AND s.id = e.src LEFT JOIN snap d ON d.as_of_step = e.snapshot_as_of AND d.id = e.dst)"""


def ratios(n: str = "n", p: str = "p", tp: str = "tp", fp: str = "fp") -> str:
    """Confusion columns from four totals, rounded as in the catalogue."""
    return f"""{n}::BIGINT AS transactions, {tp}::BIGINT AS tp, {fp}::BIGINT AS fp, ({p} - {tp})::BIGINT AS fn, ({n} - {p} - {fp})::BIGINT AS tn,
  round({tp} / nullif({tp} + {fp}, 0), 9) AS precision, round({tp} / nullif({p}, 0), 9) AS recall, round(2 * {tp} / nullif({tp} + {fp} + {p}, 0), 9) AS f1,
  round({p} / nullif({n}, 0), 9) AS prevalence, round(({tp} + {fp}) / nullif({n}, 0), 9) AS alert_rate"""


#: A rule score with few levels, expressible on both sides.
SCORE = "least(1.0, (floor(amount / 25) * 0.1) + CASE WHEN type = 'TRANSFER' THEN 0.05 ELSE 0.0 END)"
TH = "(VALUES (0.001), (0.005), (0.01), (0.02), (0.05), (0.1), (0.2), (0.3), (0.5), (0.7), (0.9), (0.99)) AS g(threshold)"
HIST = f"sc AS (SELECT *, round({SCORE}, 6)::DOUBLE AS risk_score FROM ev), hist AS (SELECT risk_score, isFraud, count(*) AS n FROM sc GROUP BY ALL)"
FAN_W = (1, 6, 24, 72)


def fanin_ctes() -> str:
    frames = ", ".join(f"w{h} AS (PARTITION BY dst ORDER BY step RANGE BETWEEN {h} PRECEDING AND 1 PRECEDING)" for h in FAN_W)
    record = "{'s': src, 't': step, 'm': amount, 'e': event_id}"
    cols = ", ".join(f"count(*) OVER w{h} AS prior_count_{h}h, min({record}) OVER w{h} AS lo{h}, max({record}) OVER w{h} AS hi{h}" for h in FAN_W)
    out = ", ".join(f"prior_count_{h}h, CASE WHEN lo{h}.s <> src THEN lo{h}.e WHEN hi{h}.s <> src THEN hi{h}.e END AS witness_{h}h" for h in FAN_W)
    return f"fw AS (SELECT event_id, src, dst, step, amount, {cols} FROM ev WHERE type = 'CASH_OUT' AND src <> dst WINDOW {frames}), fan AS (SELECT event_id, src, dst, step, amount, {out} FROM fw)"


#: Training and validation ends of rule selection, and the rows judged there.
SPLIT = "tc AS MATERIALIZED (SELECT quantile_disc(step, 0.6) AS t0, quantile_disc(step, 0.8) AS t1 FROM ev), va AS (SELECT event_id, isFraud FROM ev, tc WHERE step > t0 AND step <= t1), su AS (SELECT count(*) AS n, sum(isFraud) AS p FROM va)"


def judged(keys: str, rows: str) -> str:
    """Measures per rule of (keys, event_id, isFraud, hit) rows against the support ``su``."""
    return f"""jr AS (SELECT {keys}, count(*) FILTER (hit AND isFraud = 1) AS tp, count(*) FILTER (hit AND isFraud = 0) AS fp FROM ({rows}) GROUP BY ALL)
  SELECT {keys}, (tp + fp)::BIGINT AS alerts, n::BIGINT AS transactions, p::BIGINT AS positives, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / nullif(tp + fp, 0), 9) AS precision,
    round(tp / nullif(p, 0), 9) AS recall, round(2 * tp / nullif(tp + fp + p, 0), 9) AS f1 FROM jr, su"""


def witness_sql(family: str, hours: int, per: int, typed: bool = False) -> str:
    """Latest past row of the family per event, by comparing all pairs."""
    link = {"fanin": "p.dst = e.dst AND p.src <> e.src", "fanout": "p.src = e.src AND p.dst <> e.dst", "relay": "p.dst = e.src AND p.src <> e.dst"}[family]
    if family == "relay" and typed:
        link += " AND p.type = 'TRANSFER' AND e.type = 'CASH_OUT'"
    return f"""SELECT '{family}' AS family, event_id, w.e AS witness_id, w.s AS witness_step FROM (SELECT e.event_id, max({{'s': p.step, 'e': p.event_id}}) AS w FROM el e JOIN el p
      ON {link} AND p.payment_currency = e.payment_currency AND e.step - p.step BETWEEN 1 AND {hours * 3600 // per} GROUP BY e.event_id)"""


def surfer_ctes(iterations: int, repair: bool = True) -> str:
    """Unrolled random surfer from 1/n with jumps from accounts without payments."""
    parts = [
        "sv AS MATERIALIZED (SELECT id, id NOT IN (SELECT src FROM ev) AS dangling, count(*) OVER () AS n FROM (SELECT src AS id FROM ev UNION SELECT dst FROM ev))",
        "sw AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM (SELECT src, dst, count(*) AS n FROM ev GROUP BY ALL))",
        "s_0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS p FROM sv)",
    ]
    for k in range(iterations):
        lost = f"(SELECT coalesce(sum(p), 0) FROM s_{k} JOIN sv USING (id) WHERE dangling)" if repair else "0"
        parts.append(
            f"s_{k + 1} AS MATERIALIZED (SELECT id, 0.15 / n + 0.85 * {lost} / n + 0.85 * coalesce(x, 0) AS p FROM sv LEFT JOIN (SELECT dst AS id, sum(p * w) AS x FROM s_{k} JOIN sw ON id = src GROUP BY 1) USING (id))"
        )
    return ", ".join(parts)


BANK = "(SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS bank_id, c_name AS account, 'Corporation' AS account_type, c_nationkey AS nation FROM customer UNION ALL SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0'), s_name, 'Partnership', s_nationkey FROM supplier)"
IBV = f"ibv AS (SELECT CAST(nation AS VARCHAR) || '_' || account AS id, CAST(nation AS VARCHAR) AS bank_id, account_type, n_name AS bank_name, 0.0::DOUBLE AS balance FROM {BANK} JOIN nation ON nation = n_nationkey)"
IBE = """ibe AS (SELECT c_nationkey || '_' || c_name AS src, s_nationkey || '_' || s_name AS dst, l_extendedprice AS amount, epoch(date_trunc('minute', o_orderdate))::BIGINT AS step, l_returnflag AS type,
  CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END AS isFraud FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
