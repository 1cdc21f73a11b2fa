"""Grids of simple alert rules, evaluated in one pass by exploding the grid beside the evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.order import quantiles
from flowlattice.functions.scores import confusion
from flowlattice.operators.clean import require_unlabelled

#: Grids of the protocol (fixed values).
FANIN_WINDOWS, FANIN_PRIORS, FANIN_QUANTILES = [1, 6, 24, 72], [1, 2, 5], [0.9, 0.95, 0.99, 0.995, 0.999]
CYCLE_HOURS, CYCLE_RATIOS, CYCLE_QUANTILES = [1, 6, 24, 72, 168, 504], [0.0, 0.5, 0.8, 0.95], [0.0, 0.5, 0.9]
COMPONENT_TAILS = [0.01, 0.05, 0.1, 0.9, 0.95, 0.99]
BRANCHES = {"centrality": ["degree", "pagerank"], "community": ["community_size", "community_cross_fraction"]}


def _rows(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _score(rows: DataFrame, keys: Sequence[str], support: DataFrame) -> DataFrame:
    """Totals of rows (keys, hit, isFraud, n), beside the support's transactions and positives."""
    hit, n, y = F.col("hit"), F.col("n"), F.col("isFraud") == 1

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("long")

    counted = rows.groupBy(*keys).agg(total(hit & y).alias("tp"), total(hit & ~y).alias("fp")).join(F.broadcast(support), F.lit(True))  # one row
    measures = confusion(F.col("n_all"), F.col("p_all"), F.col("tp"), F.col("fp"))
    return counted.select(*keys, (F.col("tp") + F.col("fp")).alias("alerts"), F.col("n_all").alias("transactions"), F.col("p_all").alias("positives"), *[c.alias(k) for k, c in measures.items() if k in ("tp", "fp", "precision", "recall", "f1")])


def support_of(truth: DataFrame) -> DataFrame:
    """One row (n_all, p_all) of the rows judged; none at all is an error."""
    if truth.isEmpty():
        raise ValueError("the split has no rows")
    return truth.agg(F.count("*").alias("n_all"), F.coalesce(F.sum("isFraud"), F.lit(0)).cast("long").alias("p_all"))


def fanin_floors(edges: DataFrame, train_end: int, cuts: Sequence[float] = FANIN_QUANTILES) -> dict[float, float]:
    """quantile -> amount floor, learned from unlabelled CASH_OUT rows up to ``train_end``; 0 stands for no floor."""
    require_unlabelled(edges.schema)
    found = quantiles(edges.where((F.col("step") <= train_end) & (F.col("type") == "CASH_OUT") & (F.col("amount") > 0)), "amount", cuts)
    if None in found:
        raise ValueError("no amounts to learn floors from")
    return {0.0: 0.0, **dict(zip(cuts, map(float, found), strict=True))}


def usable_priors(window: int) -> Column:
    """Past payments of a window that count as fan-in: none unless one came from another sender; without a window any number."""
    return F.when(F.col(f"witness_{window}h").isNotNull(), F.col(f"prior_count_{window}h")).otherwise(0) if window else F.lit(1 << 60)


def fanin_grid(features: DataFrame, truth: DataFrame, floors: dict[float, float]) -> DataFrame:
    """(family, window, min_prior, quantile, floor, alerts, ...) over the rows of ``truth`` (event_id, isFraud).

    A fan-in rule asks for enough prior payments, one of them from another sender, and
    an amount above the floor; an amount-only rule for the amount alone.  Rows become a
    histogram of grid levels first, so the rules multiply that and not the rows.
    """
    require_unlabelled(features.schema)
    ranked = sorted(floors.items())
    level = sum((F.when(F.col("amount") > f, 1).otherwise(0) for _, f in ranked), F.lit(0))
    reached = [sum((F.when(usable_priors(h) >= k, 1).otherwise(0) for k in FANIN_PRIORS), F.lit(0)).alias(f"c_{h}") for h in FANIN_WINDOWS]
    joined = features.join(truth.select("event_id", "isFraud"), "event_id")
    levels = [f"c_{h}" for h in FANIN_WINDOWS]
    histogram = joined.select("isFraud", level.alias("level"), *reached).groupBy("level", "isFraud", *levels).agg(F.count("*").alias("n"))

    def rule(family: str, h: int, k: int, i: int, hit: Column) -> Column:
        q, f = ranked[i]
        return _rows({"family": F.lit(family), "window": F.lit(h), "min_prior": F.lit(k), "quantile": F.lit(q), "floor": F.lit(f), "hit": hit & (F.col("level") >= i + 1)})

    grid = [rule("fanin", h, k, i, F.col(f"c_{h}") >= FANIN_PRIORS.index(k) + 1) for h in FANIN_WINDOWS for k in FANIN_PRIORS for i in range(len(ranked))]
    grid += [rule("amount_only", 0, 0, i, F.lit(True)) for i in range(len(ranked))]
    return _score(histogram.select("isFraud", "n", F.inline(F.array(*grid))), ["family", "window", "min_prior", "quantile", "floor"], support_of(truth))


def fanin_alerts(features: DataFrame, family: str, window: int, min_prior: int, floor: float) -> DataFrame:
    """Event ids that one rule alerts, without labels; amount-only rules have window 0, the family ``abstain`` alerts none."""
    require_unlabelled(features.schema)
    if family not in ("fanin", "amount_only", "abstain"):
        raise ValueError(f"no rule family {family!r}")
    wanted = F.lit(family != "abstain") & (usable_priors(window) >= min_prior)
    return features.where(wanted & (F.col("amount") > floor)).select("event_id")


def cycle_floors(edges: DataFrame, train_end: int, cuts: Sequence[float] = CYCLE_QUANTILES[1:]) -> DataFrame:
    """(payment_currency, quantile, floor): quantiles of positive amounts per currency up to ``train_end``."""
    require_unlabelled(edges.schema)
    rows = edges.where((F.col("step") <= train_end) & (F.col("amount") > 0))
    each = F.array(*[F.struct(F.lit(q).alias("quantile"), F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY amount)").alias("floor")) for q in cuts])
    return rows.groupBy("payment_currency").agg(each.alias("x")).select("payment_currency", F.inline("x"))


def cycle_grid(cycles: DataFrame, truth: DataFrame, floors: DataFrame) -> DataFrame:
    """(hours, ratio, quantile, alerts, ...): an event of ``truth`` alerts if one of its cycles satisfies all three.

    The least amount of a cycle must exceed its currency's floor; quantile 0 is the
    floor 0.  Evidence is cut to distinct grid levels per event before the rules are
    exploded.
    """
    require_unlabelled(cycles.schema)
    wide = floors.groupBy("payment_currency").agg(F.map_from_entries(F.collect_list(F.struct("quantile", "floor"))).alias("floors"))
    own = cycles.join(F.broadcast(wide), "payment_currency", "left").join(truth.select("event_id", "isFraud"), "event_id")  # a row per currency
    hours = sum((F.when(F.col("gap_seconds") > h * 3600, 1).otherwise(0) for h in CYCLE_HOURS), F.lit(0))
    ratio = sum((F.when(F.col("amount_ratio") >= r, 1).otherwise(0) for r in CYCLE_RATIOS), F.lit(0))
    above = sum((F.when(F.col("minimum_cycle_amount") > (F.lit(0.0) if q == 0 else F.try_element_at("floors", F.lit(q))), 1).otherwise(0) for q in CYCLE_QUANTILES), F.lit(0))
    levels = own.select("event_id", "isFraud", hours.alias("h"), ratio.alias("r"), above.alias("f")).distinct()
    grid = F.array(*[
        _rows({"hours": F.lit(h), "ratio": F.lit(r), "quantile": F.lit(q), "hit": (F.col("h") <= i) & (F.col("r") >= j + 1) & (F.col("f") >= k + 1)})
        for i, h in enumerate(CYCLE_HOURS) for j, r in enumerate(CYCLE_RATIOS) for k, q in enumerate(CYCLE_QUANTILES)
    ])
    hits = levels.select("event_id", "isFraud", F.inline(grid)).groupBy("hours", "ratio", "quantile", "event_id", "isFraud").agg(F.max("hit").alias("hit"))
    return _score(hits.withColumn("n", F.lit(1)), ["hours", "ratio", "quantile"], support_of(truth))


def cycle_alerts(cycles: DataFrame, floors: DataFrame, hours: int, ratio: float, quantile: float) -> DataFrame:
    """Distinct closing events that one rule alerts."""
    require_unlabelled(cycles.schema)
    kept = cycles.where((F.col("gap_seconds") <= hours * 3600) & (F.col("amount_ratio") >= ratio))
    if quantile == 0:
        return kept.where("minimum_cycle_amount > 0").select("event_id").distinct()
    own = floors.where(F.col("quantile") == quantile).select("payment_currency", "floor")
    return kept.join(F.broadcast(own), "payment_currency").where("minimum_cycle_amount > floor").select("event_id").distinct()


def component_features(joined: DataFrame) -> DataFrame:
    """Rows joined to one earlier snapshot, with the greater end of each feature and novelty as scores."""
    require_unlabelled(joined.schema)
    names = [n for branch in BRANCHES.values() for n in branch]
    scores = [F.greatest(f"src_{n}", f"dst_{n}").cast("double").alias(f"{n}_score") for n in names]
    return joined.select("event_id", *scores, F.when((F.col("src_seen") == 0) | (F.col("dst_seen") == 0), 1.0).otherwise(0.0).alias("novelty_score"))


def component_rules(snapshot: DataFrame) -> list[tuple[str, float, float, str]]:
    """(family, tail, cut, score column) of every tail of every snapshot feature, and novelty; tails keep their own rule where cuts tie."""
    require_unlabelled(snapshot.schema)
    rules = [("novelty", 1.0, 1.0, "novelty_score")]
    for name in (n for branch in BRANCHES.values() for n in branch):
        cuts = quantiles(snapshot, name, COMPONENT_TAILS)
        if None in cuts:
            raise ValueError("the snapshot is empty")
        rules += [(f"{name}_{'low' if q < 0.5 else 'high'}", q, float(c), f"{name}_score") for q, c in zip(COMPONENT_TAILS, cuts, strict=True)]
    return rules


def component_grid(features: DataFrame, truth: DataFrame, rules: Sequence[tuple[str, float, float, str]]) -> DataFrame:
    """(family, tail, cut, alerts, ...): each rule over every row of ``truth``; scores become a histogram of rule hits first."""
    hits = [(F.col(score) <= cut if family.endswith("_low") else F.col(score) >= cut).alias(f"h{i}") for i, (family, _, cut, score) in enumerate(rules)]
    joined = features.join(truth.select("event_id", "isFraud"), "event_id").select("isFraud", *hits)
    names = [f"h{i}" for i in range(len(rules))]
    histogram = joined.groupBy("isFraud", *names).agg(F.count("*").alias("n"))
    grid = F.array(*[_rows({"family": F.lit(family), "tail": F.lit(tail), "cut": F.lit(cut), "hit": F.col(f"h{i}")}) for i, (family, tail, cut, _) in enumerate(rules)])
    return _score(histogram.select("isFraud", "n", F.inline(grid)), ["family", "tail", "cut"], support_of(truth))
