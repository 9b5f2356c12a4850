import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.operators import curves, histograms, metrics
from seqloom.operators.ordered import exact_quantiles, running_sums
from seqloom.operators.scalers import (
    Scaler,
    fit_minmax_scaler,
    fit_robust_scaler,
    fit_standard_scaler,
    fit_vector_scaler,
)


def brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_mcc(tp, fp, tn, fn):
    under = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (tp * tn - fp * fn) / under if under else 0.0


def brute_cutoff(rows):
    best, at = -2.0, None
    for i in range(101):
        c = i * 0.01
        tp = sum(y == 1 and p > c for y, p in rows)
        fp = sum(y == 0 and p > c for y, p in rows)
        fn = sum(y == 1 and not p > c for y, p in rows)
        tn = len(rows) - tp - fp - fn
        m = round(brute_mcc(tp, fp, tn, fn), 12)
        if m > best:
            best, at = m, c
    return at, best


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = []
    for g in ("hot", "cold", "one"):
        for i in range({"hot": 400, "cold": 60, "one": 10}[g]):
            prob = rng.choice([round(rng.random(), 2), rng.random(), 0.29, 0.57, 1.0, 0.0])
            y = 1 if g == "one" else int(rng.random() < 0.3 + prob / 2)
            rows.append((g, y, prob, int(prob >= 0.5)))
    return spark.createDataFrame(rows, "group string, y int, y_pred_prob double, y_pred int"), rows


def test_auc_and_cutoff_match_brute_force(scored):
    df, rows = scored
    auc = {r["group"]: r["roc_auc_score"] for r in metrics.roc_auc(df, ["group"]).collect()}
    cut = {r["group"]: r for r in metrics.optimal_cutoff(df, ["group"]).collect()}
    for g in ("hot", "cold", "one"):
        part = [(y, p) for h, y, p, _ in rows if h == g]
        expected = brute_auc(part)
        assert auc[g] is None if expected is None else auc[g] == pytest.approx(expected)
        at, best = brute_cutoff(part)
        assert cut[g]["optimal_mcc_cutoff"] == at
        assert cut[g]["optimal_mcc"] == pytest.approx(best)


def test_no_keys(scored):
    df, rows = scored
    assert metrics.roc_auc(df, []).first()[0] == pytest.approx(brute_auc([(y, p) for _, y, p, _ in rows]))


def test_cutoff_edges(spark):
    # A score equal to a cutoff does not pass it; the first of equal cutoffs wins.
    for score in (0.07, 0.29, 0.57, 0.58, 0.35000000000000003, 1.0, 0.0):
        df = spark.createDataFrame([(1, score), (0, score - 0.005)], "y int, y_pred_prob double")
        row = metrics.optimal_cutoff(df, []).first()
        assert (row[0], row[1]) == brute_cutoff([(1, score), (0, score - 0.005)])


def test_confusion_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, y_pred int")
    row = metrics.classification_metrics(metrics.confusion_counts(df, [])).first()
    assert row["precision"] is None and row["recall"] is None and row["f_score"] is None
    assert row["matthews_corr_coef"] == 0.0 and row["accuracy"] == 1.0 and row["balanced_accuracy"] == 1.0
    with pytest.raises(PySparkException, match="missing values"):
        metrics.confusion_counts(spark.createDataFrame([(0, None)], "y int, y_pred int"), []).collect()


def test_regression_small_groups(spark):
    rows = [("a", 1.0, 1.5), ("a", 2.0, 1.0), ("b", 1.0, 2.0), ("b", 2.0, 2.0), ("b", 3.0, 5.0), ("b", 4.0, 4.0)]
    df = spark.createDataFrame(rows, "group string, y double, y_pred double")
    out = {r["group"]: r for r in metrics.regression_metrics(df, ["group"]).collect()}
    assert out["a"]["pearson_r"] is None and out["a"]["spearman_r"] is None and out["a"]["r_squared"] is None
    assert out["a"]["mae"] == pytest.approx(0.75)
    # ranks of y 1 2 3 4, of y_pred 1.5 1.5 4 3
    assert out["b"]["spearman_r"] == pytest.approx(0.7378647873726218)
    labels = {r["group"]: r["label"] for r in metrics.group_label_stats(df).collect()}
    assert labels == {"a": "a (n=2, sp_r=N/A)", "b": "b (n=4, sp_r=0.74)"}


def test_metrics_by_group_has_overall_and_skips_missing_group(spark):
    rows = [("train", "g", 1, 1, 0.9), ("train", None, 0, 0, 0.1), ("test", "g", 0, 1, 0.8), ("test", "g", 1, 1, 0.9)]
    df = spark.createDataFrame(rows, "data_split string, group string, y int, y_pred int, y_pred_prob double")
    out = {(r["data_split"], r["group"]): r for r in metrics.metrics_by_split_group(df).collect()}
    assert set(out) == {("train", ""), ("train", "g"), ("test", ""), ("test", "g")}
    assert out["train", ""]["total"] == 2 and out["train", "g"]["total"] == 1
    assert out["train", ""]["roc_auc_score"] == 1.0 and out["train", "g"]["roc_auc_score"] is None
    names = {r["metric"] for r in metrics.metric_names_long(
        spark.createDataFrame([("train", "", 1.0), ("train", "g", 2.0)], "data_split string, group string, accuracy double"),
        ["accuracy"]).collect()}
    assert names == {"train.accuracy", "train.g.accuracy"}


def test_curves(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, y_pred_prob double")
    roc = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in curves.roc_points(df, []).collect()), reverse=True)
    assert roc == [(0.9, 0.0, 0.5), (0.8, 0.5, 1.0), (0.1, 1.0, 1.0)]
    pr = [(r["threshold"], r["precision"], r["recall"]) for r in curves.pr_points(df, []).collect()]
    assert (None, 1.0, 0.0) in pr and (0.8, pytest.approx(2 / 3), 1.0) in pr and len(pr) == 4
    cells = {(r["actual"], r["predicted"]): (r["n"], r["share"]) for r in curves.confusion_matrix(
        df.withColumn("y_pred", F.lit(1))).collect()}
    assert cells[0, 0] == (0, 0.0) and cells[1, 1] == (2, 1.0)


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([("train", float(i)) for i in range(21)] + [("test", 5.0)], "data_split string, y double")
    rows = histograms.target_histogram(df).collect()
    train = {r["bin"]: r["n"] for r in rows if r["data_split"] == "train"}
    assert train[19] == 2 and sum(train.values()) == 21
    area = sum(r["density"] * (r["bin_end"] - r["bin_start"]) for r in rows if r["data_split"] == "train")
    assert area == pytest.approx(1.0)
    assert [r["n"] for r in rows if r["data_split"] == "test"] == [1]


def test_running_sums_with_a_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 100 < 95, "hot").otherwise("cold").alias("k"), F.col("id").alias("v"), F.lit(1).alias("n")
    )
    rows = running_sums(df, ["k"], "v", ["n"]).collect()
    for key in ("hot", "cold"):
        part = sorted((r["v"], r["cum_n"], r["total_n"]) for r in rows if r["k"] == key)
        assert [c for _, c, _ in part] == list(range(1, len(part) + 1))
        assert {t for _, _, t in part} == {len(part)}


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 10.0)], "x double")
    row = exact_quantiles(df, [], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    assert list(row) == pytest.approx([1.0, 1.75, 2.0, 7.6, 10.0])


def test_scalers_round_trip(spark):
    df = spark.createDataFrame([(float(i), 3.0, i % 7) for i in range(50)], "a double, b double, c int")
    for fit in (fit_robust_scaler, fit_minmax_scaler, fit_standard_scaler):
        scaler = fit(df, ["a", "b", "c"])
        again = Scaler.from_table(scaler.to_table(spark))
        back = again.restore(scaler.apply(df)).agg(F.max(F.abs(F.col("a") + 0)), F.sum("b")).first()
        assert back[0] == pytest.approx(49.0) and back[1] == pytest.approx(150.0)
        assert scaler.scale["b"] == 1.0  # a constant column is only shifted
    approx = fit_robust_scaler(df, ["a"], accuracy=10000)
    assert approx.scale["a"] == pytest.approx(24.5, abs=1.0)


@pytest.mark.parametrize("kind", ["StandardScaler", "MinMaxScaler", "RobustScaler"])
def test_vector_scaler(spark, kind):
    df = spark.createDataFrame([([float(i), 5.0],) for i in range(9)], "v array<double>")
    scaler = fit_vector_scaler(df, "v", kind)
    rows = [r[0] for r in df.select(scaler.forward(F.col("v"))).collect()]
    assert {r[1] for r in rows} == {0.0}
    first = [r[0] for r in rows]
    expected = {"StandardScaler": (0 - 4) / math.sqrt(60 / 9), "MinMaxScaler": 0.0, "RobustScaler": -1.0}[kind]
    assert min(first) == pytest.approx(expected)


def test_a_blank_group_counts_once(spark):
    rows = [("test", "", 1, 1, 0.9), ("test", "", 0, 0, 0.2), ("test", "a", 1, 0, 0.4), ("test", None, 0, 1, 0.6)]
    df = spark.createDataFrame(rows, "data_split string, `group` string, y int, y_pred int, y_pred_prob double")
    got = {r["group"]: r["total"] for r in metrics.metrics_by_split_group(df).collect()}
    assert got == {"": 4, "a": 1}


def test_unlabelled_rows_have_one_total(spark):
    rows = [("test", "a", 1, 1, 0.9), ("test", "a", None, 1, 0.8), ("test", "a", 0, 1, 0.7)]
    df = spark.createDataFrame(rows, "data_split string, `group` string, y int, y_pred int, y_pred_prob double")
    counted = metrics.confusion_counts(df, ["data_split", "group"]).first()["total"]
    table = {r["group"]: r["total"] for r in metrics.metrics_by_split_group(df).collect()}
    assert counted == table["a"] == 2


def test_null_keys_keep_their_points_and_ranks(spark):
    rows = [(k, float(i % 2), i / 10) for k in ("a", None) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, y double, y_pred_prob double")
    points = curves.roc_points(df, ["k"])
    assert points.where("k IS NULL").count() == points.where("k = 'a'").count() == 6
    got = {r["k"]: r["spearman_r"] for r in metrics.spearman(df, ["k"], "y", "y_pred_prob").collect()}
    assert got[None] == got["a"] is not None
    table = metrics.regression_metrics(df, ["k"], "y", "y_pred_prob").collect()
    assert len(table) == 2 and all(r["spearman_r"] is not None for r in table)
