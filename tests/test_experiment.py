"""The experiment's life cycle and the command line on small graphs."""

import json

import pytest
from pyspark.sql import functions as F

from flowlattice import cli
from flowlattice.operators import models
from flowlattice.plans.experiment import FOLDS, Experiment, Settings, seconds_per_million
from flowlattice.sources.tables import INTERBANK_HEADER, TxGraph


def labelled_edges(spark, n=800):
    """Positives are the large payments, so a tree on the amount alone finds them."""
    return spark.range(n).selectExpr(
        "concat('A', id % 13) AS src", "concat('A', (id * 7 + 3) % 11) AS dst", "id div 2 AS step", "IF(id % 5 = 0, 900.0D, 10.0D + id % 3) AS amount", "IF(id % 2 = 0, 'TRANSFER', 'CASH_OUT') AS type",
        "'U' AS payment_currency", "'U' AS receiving_currency", "smallint(id % 5 = 0) AS isFraud",
    )


SETTINGS = Settings(models.Protocol((6, 24), min_leaf=5), 3600, True, ("transaction_only", "motif_assisted"))


def test_life_cycle(spark, tmp_path):
    edges = labelled_edges(spark)
    run = Experiment(spark, edges, str(tmp_path / "tables"), str(tmp_path / "notes"), SETTINGS)
    with pytest.raises(ValueError, match="needs"):
        run.test()
    record = run.run()
    assert record["phases"]["validation"]["fits"] == len(FOLDS) * 2 and record["phases"]["reliability"]["contrasts"] == 1
    assert models.frozen(str(tmp_path / "notes"))["selected"]["family"] == "transaction_only"  # the simpler of two equals
    best = run.table("test_metrics").where("model = 'transaction_only'").first()
    assert (best.precision, best.recall, best.average_precision) == (1.0, 1.0, 1.0)
    assert set(seconds_per_million(record)) == set(record["phases"])
    run.verify()
    # a second run reads what the first one wrote
    again = Experiment(spark, edges.limit(0), str(tmp_path / "tables"), str(tmp_path / "notes"), SETTINGS)
    assert again.run() == record
    with pytest.raises(ValueError, match="other settings"):
        Experiment(spark, edges, str(tmp_path / "tables"), str(tmp_path / "notes"), Settings())
    # tampering is found
    (tmp_path / "notes" / "contrasts.csv").write_text("changed")
    with pytest.raises(ValueError):
        again.verify()


@pytest.mark.parametrize("bad", [{"seconds_per_step": 0}, {"seconds_per_step": 7}, {"families": ()}, {"families": ("no",)}, {"families": ("full_fusion", "full_fusion")}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def test_bad_rows_stop_the_run(spark, tmp_path):
    bad = labelled_edges(spark, 20).withColumn("amount", F.when(F.col("step") == 3, -1.0).otherwise(F.col("amount")))
    run = Experiment(spark, bad, str(tmp_path / "t"), str(tmp_path / "n"), SETTINGS)
    with pytest.raises(ValueError, match="contract"):
        run.prepare()
    assert run.record["phases"] == {}


def test_command_line(spark, tmp_path, capsys):
    accounts = "Bank Name,Bank ID,Account Number,Entity ID,Entity Name\n" + "".join(f"Bank {i % 3},0{i % 3 + 1},X{i},E{i},Corporation #{i}\n" for i in range(9))
    rows = [f"2022/09/0{1 + k % 9} 0{k % 10}:1{k % 6},0{k % 9 % 3 + 1},X{k % 9},0{(k * 5 + 1) % 9 % 3 + 1},X{(k * 5 + 1) % 9},{k + 1}.5,Euro,{k + 1}.5,Euro,Wire,{int(k % 7 == 0)}" for k in range(120)]
    (tmp_path / "a.csv").write_text(accounts)
    (tmp_path / "t.csv").write_text(",".join(INTERBANK_HEADER) + "\n" + "\n".join(rows) + "\n")
    folder, notes = str(tmp_path / "g"), str(tmp_path / "notes")
    cli.main(["etl-interbank", "--transactions", str(tmp_path / "t.csv"), "--accounts", str(tmp_path / "a.csv"), "--out", folder, "--sample", "40", "--sample-positives", "5"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["n_edges"] == 120
    assert TxGraph.read(spark, f"{folder}/sample").edges.where("isFraud = 1").count() == 5
    cli.main(["verify", "--graph", folder, "--types", "Wire", "--account-types", "Corporation", "--first-step", "0", "--last-step", "2000000000"])
    cli.main(["profile", "--graph", folder])
    cli.main(["centrality", "--graph", folder, "--out", folder, "--notes", notes])
    cli.main(["communities", "--graph", folder, "--out", folder, "--notes", notes])
    cli.main(["motif", "--graph", folder, "--out", folder, "--notes", notes])
    assert spark.read.parquet(f"{folder}/motif_features.parquet").count() == 120
    assert len((tmp_path / "notes" / "top10_pagerank.csv").read_text().splitlines()) == 10
    (tmp_path / "m.csv").write_text("step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n1,PAYMENT,5,C1,9,4,M1,0,0,0,0\n")
    cli.main(["etl-mobile", "--transactions", str(tmp_path / "m.csv"), "--out", str(tmp_path / "m")])
    cli.main(["verify", "--graph", str(tmp_path / "m")])
    with pytest.raises(ValueError):
        cli.main(["verify", "--graph", folder])
    (tmp_path / "t.csv").write_text(",".join(INTERBANK_HEADER[::-1]) + "\n")
    with pytest.raises(ValueError):
        cli.main(["etl-interbank", "--transactions", str(tmp_path / "t.csv"), "--accounts", str(tmp_path / "a.csv"), "--out", folder])
