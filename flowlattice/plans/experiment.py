"""The experiment's life cycle: features, walk-forward selection, freeze, frozen test, reliability.

Each phase writes its tables below the run's folder and an entry (inputs, row counts,
seconds) to ``record.json``; a phase that is recorded is read again instead of run, if
the parameters are the same.  Rules are frozen, with a digest, before any test row is
scored, and labels are joined after every feature and every score.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlattice.operators import asof, clean, evaluate, models, motifs
from flowlattice.sources.scratch import cut_lineage
from flowlattice.sources.sinks import verify_manifest, write_manifest, write_single_csv

#: Validation blocks between the snapshot cutoffs, and the cutoff before the test (fixed values of the protocol).
FOLDS = [(1, 2), (2, 3), (3, 4)]
TEST_CUT = 4


@dataclass(frozen=True)
class Settings:
    """What a run depends on besides its input."""

    protocol: models.Protocol = field(default_factory=models.Protocol)
    seconds_per_step: int = 1
    typed_relay: bool = False
    families: tuple[str, ...] = tuple(models.FAMILIES)

    def __post_init__(self) -> None:
        if self.seconds_per_step <= 0 or 3600 % self.seconds_per_step:
            raise ValueError("a step must divide an hour")
        if not self.families or len(set(self.families)) != len(self.families) or set(self.families) - set(models.FAMILIES):
            raise ValueError(f"families must be different names of {list(models.FAMILIES)}")


class Experiment:
    """One run over the edges of a graph in a folder of its own.

    Tables are Parquet at ``folder`` (any path Spark reads); the record, frozen rules
    and reports are small files in the local ``notes`` folder of the driver.
    """

    def __init__(self, spark: SparkSession, edges: DataFrame, folder: str, notes: str, settings: Settings | None = None):
        self.spark, self.edges, self.folder, self.notes = spark, edges, folder.rstrip("/"), Path(notes)
        self.settings = settings or Settings()
        self.notes.mkdir(parents=True, exist_ok=True)
        path = self.notes / "record.json"
        parameters = json.loads(json.dumps(asdict(self.settings)))
        self.record = json.loads(path.read_text()) if path.exists() else {"parameters": parameters, "phases": {}}
        if self.record["parameters"] != parameters:
            raise ValueError("the folder holds a run with other settings")

    # --- bookkeeping

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.table(name)

    def _phase(self, name: str, work: Callable[[], dict], needs: Sequence[str] = ()) -> dict:
        missing = [n for n in needs if n not in self.record["phases"]]
        if missing:
            raise ValueError(f"phase {name} needs {missing} first")
        if name not in self.record["phases"]:
            began = time.perf_counter()
            details = work()
            self.record["phases"][name] = details | {"seconds": round(time.perf_counter() - began, 3)}
            (self.notes / "record.json").write_text(json.dumps(self.record, indent=1, sort_keys=True))
        return self.record["phases"][name]

    # --- phases

    def prepare(self) -> dict:
        """Check and number the edges; features and labels go apart."""

        def work() -> dict:
            rows = clean.normalize_edges(self.edges, None)
            rows = rows.withColumn("event_id", F.monotonically_increasing_id())
            rows = self._write(rows, "transactions")
            self._write(rows.drop("isFraud"), "features")
            self._write(rows.select("event_id", "step", F.col("isFraud").cast("int").alias("isFraud")), "truth")
            cuts = asof.cutoffs(rows)
            support = asof.phase_support(self.table("truth"), cuts[1:]).collect()  # the first cutoff only bounds a snapshot
            return {"transactions": rows.count(), "cuts": cuts, "support": {r["phase"]: [r["transactions"], r["positives"]] for r in support}}

        return self._phase("prepare", work)

    def build_features(self) -> dict:
        """Motif features and, per block, the ends' features in the last snapshot before it."""

        def work() -> dict:
            s, cuts = self.settings, self.record["phases"]["prepare"]["cuts"]
            rows = self.table("features")
            motif = self._write(motifs.motif_features(rows, s.protocol.windows, s.seconds_per_step, s.typed_relay), "motifs")
            snap = self._write(asof.snapshots(rows, cuts, seed=F.col("id")), "snapshots")
            joined = asof.join_snapshots(rows, snap, cuts)
            leaks = asof.future_leaks(joined)
            if leaks:
                raise ValueError(f"{leaks} rows met a snapshot that is not older than they are")
            whole = self._write(joined.join(motif, "event_id"), "model_rows")
            if whole.count() != self.record["phases"]["prepare"]["transactions"]:
                raise ValueError("the feature table lost or repeated rows")
            return {"columns": len(whole.columns)}

        return self._phase("features", work, ["prepare"])

    def _labelled(self) -> DataFrame:
        return self.table("model_rows").join(self.table("truth").select("event_id", "isFraud"), "event_id")

    def validate(self) -> dict:
        """Fit every family on each prefix, score the next block, and rank (family, threshold)."""

        def work() -> dict:
            cuts, found = self.record["phases"]["prepare"]["cuts"], []
            rows = cut_lineage(self._labelled(), "model-rows")
            for fold, (a, b) in enumerate(FOLDS):
                train = rows.where(F.col("step") <= cuts[a])
                valid = rows.where((F.col("step") > cuts[a]) & (F.col("step") <= cuts[b]))
                scales = models.amount_scales(train)
                for family in self.settings.families:
                    scored = models.score(models.fit(train, family, self.settings.protocol, scales), valid)
                    found.append(evaluate.score_histogram(scored.select("risk_score", "isFraud", F.lit(fold).alias("fold"), F.lit(family).alias("family")), ["fold", "family"]))
            folds = self._write(evaluate.metrics_at(motifs.union_all(found), evaluate.THRESHOLDS, ["fold", "family"]), "validation_folds")
            order = [(f, 0 if f == "transaction_only" else 1 + len(models.FAMILIES[f])) for f in self.settings.families]
            board = self._write(evaluate.leaderboard(folds, len(FOLDS), self.spark.createDataFrame(order, "family string, complexity int")), "leaderboard")
            best = {f: evaluate.select_rule(board.where(F.col("family") == f)).first() for f in self.settings.families}
            chosen = evaluate.select_rule(board).first()
            rules = {"selected": {"family": chosen["family"], "threshold": chosen["threshold"]}, "families": {f: r["threshold"] for f, r in best.items()}}
            return {"fits": len(FOLDS) * len(self.settings.families), "digest": models.freeze(rules, str(self.notes))}

        return self._phase("validation", work, ["features"])

    def test(self) -> dict:
        """Refit every family up to the test, score the test by saved models and frozen thresholds, and replay one."""

        def work() -> dict:
            rules, cut = models.frozen(str(self.notes)), self.record["phases"]["prepare"]["cuts"][TEST_CUT]
            rows = cut_lineage(self._labelled(), "model-rows")
            train, test = rows.where(F.col("step") <= cut), rows.where(F.col("step") > cut).drop("isFraud")
            scales = models.amount_scales(train)
            parts = []
            for family in self.settings.families:
                model = models.fit(train, family, self.settings.protocol, scales)
                threshold = rules["families"][family]
                if model.pipeline is None:
                    scored = models.score(model, test).select("event_id", "step", "risk_score", (F.col("risk_score") >= threshold).alias("alert"))
                else:
                    models.save(model, f"{self.folder}/models/{family}")
                    scored = models.frozen_prediction(self.spark, f"{self.folder}/models/{family}", test, threshold)
                parts.append(self._write(scored.withColumn("model", F.lit(family)), f"predictions/model={family}").drop("model").withColumn("model", F.lit(family)))
                if model.pipeline is not None and family == rules["selected"]["family"]:
                    faults = models.replay_faults(models.score(model, test).select("event_id", "risk_score"), parts[-1]).first()["mismatches"]
                    if faults:
                        raise ValueError(f"{faults} predictions of the saved model differ")
            truth = self.table("truth").select("event_id", "isFraud")
            judged = motifs.union_all(parts).join(truth, "event_id")
            histogram = self._write(evaluate.score_histogram(judged, ["model"]), "test_histogram")
            metrics = self._metrics(histogram.withColumn("period", F.lit(0)), rules["families"])
            self._write(metrics, "test_metrics")
            support = truth.join(test.select("event_id"), "event_id").agg(F.count("*"), F.sum("isFraud")).first()
            return {"transactions": support[0], "positives": int(support[1] or 0), "models": len(parts)}

        return self._phase("test", work, ["validation"])

    @staticmethod
    def _metrics(histogram: DataFrame, thresholds: dict[str, float]) -> DataFrame:
        return evaluate.stability(histogram, thresholds)

    def reliability(self) -> dict:
        """Measures per test period with bounds, their spread, and the contrasts of the feature groups."""

        def work() -> dict:
            rules = models.frozen(str(self.notes))
            done = self.record["phases"]["test"]
            test = self.table("predictions").join(self.table("truth").select("event_id", "isFraud"), "event_id")
            steps = test.select("event_id", "step").distinct()
            cuts = sorted({int(c) for c in asof.quantiles(steps, "step", (0.2, 0.4, 0.6, 0.8))})
            histogram = cut_lineage(evaluate.score_histogram(test.withColumn("period", asof.block_of(cuts)), ["model", "period"]), "periods")
            periods = self._write(self._metrics(histogram, rules["families"]), "test_periods")
            short = periods.groupBy("model").agg(F.sum("transactions").alias("n"), F.sum(F.col("tp") + F.col("fn")).alias("p")).where((F.col("n") != done["transactions"]) | (F.col("p") != done["positives"]))
            if not short.isEmpty():
                raise ValueError("the periods lost test rows")
            write_single_csv(periods.orderBy("model", "period"), self.notes / "test_periods.csv", "utf-8-sig")
            write_single_csv(evaluate.reliability(periods).orderBy("model"), self.notes / "reliability.csv", "utf-8-sig")
            present = [c for c in evaluate.CONTRASTS if {c[1], c[2]} <= set(self.settings.families)]
            if present:
                write_single_csv(evaluate.contrasts(self.table("test_metrics"), present).orderBy("contrast"), self.notes / "contrasts.csv", "utf-8-sig")
            return {"period_cuts": cuts, "contrasts": len(present)}

        return self._phase("reliability", work, ["test"])

    def finish(self) -> dict:
        """Manifest of the notes; the run is complete."""

        def work() -> dict:
            files = sorted(str(p) for p in self.notes.iterdir() if p.name not in ("record.json", "manifest.json"))
            write_manifest(self.notes / "manifest.json", "experiment", [], files, self.record["parameters"], {k: v["seconds"] for k, v in self.record["phases"].items()})
            return {"files": len(files)}

        return self._phase("finish", work, ["reliability"])

    def run(self) -> dict:
        for phase in (self.prepare, self.build_features, self.validate, self.test, self.reliability, self.finish):
            phase()
        return self.record

    def verify(self) -> None:
        """Raise unless the notes, rules and tables of a finished run still agree."""
        verify_manifest(self.notes / "manifest.json", "experiment")
        models.frozen(str(self.notes))
        rows = self.record["phases"]["prepare"]["transactions"]
        for name in ("transactions", "features", "truth", "model_rows"):
            if self.table(name).count() != rows:
                raise ValueError(f"{name} has lost rows")
        clean.require_unlabelled(self.table("model_rows").schema)
        clean.require_keys(self.table("model_rows"), ["event_id"], "model_rows")
        done = self.record["phases"]["test"]
        per_model = self.table("predictions").groupBy("model").agg(F.count("*").alias("n"), F.count_if(~F.col("risk_score").between(0, 1)).alias("bad"))
        if not per_model.where((F.col("n") != done["transactions"]) | (F.col("bad") > 0)).isEmpty():
            raise ValueError("predictions are incomplete or no probabilities")


def seconds_per_million(record: dict) -> dict[str, float]:
    """Cost of each phase per million transactions."""
    n = record["phases"]["prepare"]["transactions"]
    return {k: v["seconds"] / n * 1e6 if n else math.nan for k, v in record["phases"].items()}
