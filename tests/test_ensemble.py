import pytest
from pyspark.sql import functions as F

from seqloom.operators import ensemble

FOLDS = ["f1", "f2"]
SCHEMA = "seq_id long, fold_residues map<string, array<double>>"


def means(df):
    rows = df.collect()
    assert len({(r["seq_id"], r["pos"]) for r in rows}) == len(rows)
    return {(r["seq_id"], r["pos"]): r["score"] for r in rows}


def test_folds_are_averaged_inside_the_row(spark):
    rows = [(1, {"f1": [0.1, 0.2, None], "f2": [0.3, None, None]}), (2, {"f1": [], "f2": None}), (None, {"f1": [1.0], "f2": [0.0, 0.5]})]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(1, 0): 0.2, (1, 1): 0.2, (1, 2): None, (None, 0): 0.5, (None, 1): 0.5}
    own = ensemble.ensemble_residue(df, FOLDS, distinct_ids=True)
    assert "Exchange" not in own._jdf.queryExecution().toString()
    for found in (own, ensemble.ensemble_residue(df, FOLDS)):
        assert means(found) == pytest.approx(want)


def test_rows_of_one_id_meet_by_position(spark):
    rows = [(1, {"f1": [0.0, 1.0], "f2": [1.0, 1.0]}), (1, {"f1": [0.25], "f2": [0.25]}), (2, {"f1": [0.5], "f2": [1.0]})]
    rows += [(None, {"f1": [x], "f2": [x]}) for x in (0.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    once, again = ensemble.split_repeated(df)
    assert [r["seq_id"] for r in once.collect()] == [2] and again.count() == 4
    assert ensemble.split_repeated(df.where("seq_id = 2"))[1] is None
    want = {(1, 0): 0.375, (1, 1): 1.0, (None, 0): 0.5}
    assert means(ensemble.ensemble_residue(again, FOLDS)) == pytest.approx(want)
    long = df.select("seq_id", F.explode("fold_residues").alias("fold", "s")).select("seq_id", F.posexplode("s").alias("pos", "x"))
    assert means(long.groupBy("seq_id", "pos").agg(F.avg("x").alias("score"))) == pytest.approx(want | {(2, 0): 0.75})
