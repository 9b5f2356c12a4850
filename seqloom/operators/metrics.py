"""Classification and regression metrics by split and group.

Rows are first counted per distinct (keys, score), with map-side combine, so a
group holding a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CUTOFF_STEPS
from ..session import cut_lineage
from .ordered import join_same, running_sums

OVERALL = ""  # group name of the rows over all groups

CLASSIFICATION_METRICS = (
    "accuracy",
    "precision",
    "recall",
    "specificity",
    "f_score",
    "matthews_corr_coef",
    "balanced_accuracy",
    "roc_auc_score",
    "optimal_mcc_cutoff",
    "optimal_mcc",
)
REGRESSION_METRICS = ("pearson_r", "spearman_r", "mse", "mae", "r_squared")


def _checked(value: Column, name: str) -> Column:
    bad = value.isNull() | F.isnan(value)
    return F.when(bad, F.raise_error(F.lit(f"{name} has missing values"))).otherwise(value)


def confusion_counts(df: DataFrame, keys: list[str], y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """Cells per key; rows without a label count nowhere, in ``total`` neither."""
    actual = F.col(y).cast("double")
    predicted = _checked(F.col(y_pred).cast("double"), y_pred)
    hit = lambda a, p: F.count_if((actual == a) & (predicted == p))
    return df.groupBy(*keys).agg(
        hit(1, 1).alias("tp"),
        hit(0, 1).alias("fp"),
        hit(0, 0).alias("tn"),
        hit(1, 0).alias("fn"),
        F.count_if(actual == predicted).alias("tp+tn"),
        F.count(actual).alias("total"),
    )


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Matthews correlation, 0 where a margin is empty."""
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    under = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(under > 0, (tp * tn - fp * fn) / under).otherwise(F.lit(0.0))


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Metrics from confusion counts; null on a zero denominator."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    recall, specificity = share(tp, tp + fn), share(tn, tn + fp)
    # Balanced accuracy averages over the classes that occur.
    balanced = F.coalesce((recall + specificity) / 2, recall, specificity)
    return counts.withColumns(
        {
            "accuracy": share(F.col("`tp+tn`"), F.col("total")),
            "precision": share(tp, tp + fp),
            "recall": recall,
            "specificity": specificity,
            "f_score": share(2 * tp, 2 * tp + fp + fn),
            "matthews_corr_coef": mcc(tp, fp, tn, fn),
            "balanced_accuracy": balanced,
        }
    )


def score_counts(df: DataFrame, keys: list[str], y: str = "y", prob: str = "y_pred_prob") -> DataFrame:
    """Positives and negatives per distinct score: the table under every curve."""
    label = F.col(y).cast("double")
    return (
        df.select(*keys, _checked(F.col(prob).cast("double"), prob).alias("score"), label.alias("_y"))
        .groupBy(*keys, "score")
        .agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    )


def roc_auc_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Exact area with ties; null where one class is missing."""
    ranked = running_sums(counts, keys, "score", ["pos", "neg"])
    below = F.col("cum_neg") - F.col("neg")
    wins = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2.0))
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return ranked.groupBy(*keys).agg(
        F.when(pairs > 0, wins / pairs).alias("roc_auc_score")
    )


def roc_auc(df: DataFrame, keys: list[str], y: str = "y", prob: str = "y_pred_prob") -> DataFrame:
    return roc_auc_from_counts(score_counts(df, keys, y, prob), keys)


def cutoff_table(counts: DataFrame, keys: list[str]) -> DataFrame:
    """MCC at each of the 101 cutoffs ``i * 0.01`` (class 1 where score > cutoff).

    A score passes exactly the first ``passes`` cutoffs, so counts per
    ``passes`` (at most 102 per key) summed from the top give every confusion
    table; rows are never copied once per cutoff.
    """
    score = F.col("score")
    near = F.ceil(score * CUTOFF_STEPS)
    # Cutoffs are the doubles i * 0.01; settle the ones next to the score exactly.
    passes = sum(
        ((near + d) * F.lit(0.01) < score).cast("int") for d in (-1, 0, 1)
    ) + near - 1
    passes = F.when(score > CUTOFF_STEPS * 0.01, CUTOFF_STEPS + 1).otherwise(
        F.greatest(F.lit(0), F.least(passes, F.lit(CUTOFF_STEPS + 1)))
    )
    binned = (
        counts.withColumn("passes", passes.cast("int"))
        .groupBy(*keys, "passes")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # At most 102 bins per key are gathered here, whatever the data size.
    bins = binned.groupBy(*keys).agg(
        F.collect_list(F.struct("passes", "pos", "neg")).alias("bins"),
        F.sum("pos").alias("all_pos"),
        F.sum("neg").alias("all_neg"),
    )
    cutoffs = bins.select("*", F.explode(F.sequence(F.lit(0), F.lit(CUTOFF_STEPS))).alias("step"))

    def above(name: str) -> Column:
        return F.aggregate(
            "bins",
            F.lit(0).cast("long"),
            lambda acc, b: acc + F.when(b["passes"] > F.col("step"), b[name]).otherwise(F.lit(0)),
        )

    counted = cutoffs.withColumns({"tp": above("pos"), "fp": above("neg")}).withColumns(
        {"fn": F.col("all_pos") - F.col("tp"), "tn": F.col("all_neg") - F.col("fp")}
    )
    return counted.select(
        *keys,
        (F.col("step") * F.lit(0.01)).alias("cutoff"),
        mcc(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")).alias("mcc"),
    )


def argmax_first(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Row with the largest ``value``; the smallest ``order`` wins a tie."""
    best = F.max_by(F.col(order), F.struct(F.col(value), -F.col(order)))
    return df.groupBy(*keys).agg(best.alias(order), F.max(value).alias(value))


def optimal_cutoff_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    # Rounded so that equal tables reached by other sums still tie.
    table = cutoff_table(counts, keys).withColumn("mcc", F.round("mcc", 12))
    return argmax_first(table, keys, "cutoff", "mcc").select(
        *keys, F.col("cutoff").alias("optimal_mcc_cutoff"), F.col("mcc").alias("optimal_mcc")
    )


def optimal_cutoff(
    df: DataFrame, keys: list[str], y: str = "y", prob: str = "y_pred_prob"
) -> DataFrame:
    return optimal_cutoff_from_counts(score_counts(df, keys, y, prob), keys)


def average_ranks(counts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, column, value, rank): tie-averaged rank of each distinct value, from 1.

    All columns are ranked together, so the counts are ordered in one go.
    """
    long = counts.unpivot([*keys, "n"], values, "column", "value")
    per_value = long.groupBy(*keys, "column", "value").agg(F.sum("n").alias("n"))
    ranked = running_sums(per_value, [*keys, "column"], "value", ["n"])
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0
    return ranked.select(*keys, "column", "value", rank.alias("rank"))


def spearman(df: DataFrame, keys: list[str], y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """Pearson correlation of tie-averaged ranks.

    Equal (y, y_pred) pairs are counted before the rank joins; a hot value is
    one row on the rank side and is split by the skew-join rule on the other.
    """
    pairs = cut_lineage(
        df.where(F.col(y).isNotNull() & F.col(y_pred).isNotNull())
        .groupBy(*keys, F.col(y).cast("double").alias("y"), F.col(y_pred).cast("double").alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranks = average_ranks(pairs, keys, ["y", "p"])
    ranked = pairs
    for name in ("y", "p"):
        side = ranks.where(F.col("column") == name).select(
            *keys, F.col("value").alias(name), F.col("rank").alias(f"r{name}")
        )
        ranked = join_same(ranked, side, [*keys, name])
    n, ry, rp = F.col("n"), F.col("ry"), F.col("rp")
    sums = ranked.groupBy(*keys).agg(
        F.sum(n).cast("double").alias("n"),
        F.sum(n * ry * rp).alias("sxy"),
        F.sum(n * ry * ry).alias("sxx"),
        F.sum(n * rp * rp).alias("syy"),
    )
    mean = (F.col("n") + 1) / 2.0  # every set of average ranks has this mean
    off = F.col("n") * mean * mean
    under = F.sqrt(F.col("sxx") - off) * F.sqrt(F.col("syy") - off)
    value = F.when(under > 0, (F.col("sxy") - off) / under)
    return sums.select(*keys, F.when(F.col("n") > 2, value).alias("spearman_r"))


def regression_metrics(
    df: DataFrame, keys: list[str], y: str = "y", y_pred: str = "y_pred"
) -> DataFrame:
    """Pearson, Spearman and R2 (null up to 2 rows), MSE and MAE."""
    a, p = F.col(y).cast("double"), F.col(y_pred).cast("double")
    gap = a - p
    n = F.count(F.lit(1))
    spread = F.var_pop(a)
    moments = df.groupBy(*keys).agg(
        n.alias("n_rows"),
        F.when((n > 2) & (spread > 0) & (F.var_pop(p) > 0), F.corr(a, p)).alias("pearson_r"),
        F.avg(gap * gap).alias("mse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.when((n > 2) & (spread > 0), 1.0 - F.avg(gap * gap) / spread).alias("r_squared"),
    )
    return join_same(moments, spearman(df, keys, y, y_pred), keys, "left").select(
        *keys, "n_rows", *REGRESSION_METRICS
    )


def with_overall(df: DataFrame, group: str) -> DataFrame:
    """Rows once under their group, if they have one, and once under the blank one.

    A blank name is no group, like null: such rows count in the overall ones only.
    """
    if group not in df.columns:
        return df.withColumn(group, F.lit(OVERALL))
    both = F.array(F.nullif(F.col(group).cast("string"), F.lit(OVERALL)), F.lit(OVERALL))
    return df.withColumn(group, F.explode(both)).where(F.col(group).isNotNull())


def metrics_by_split_group(
    df: DataFrame,
    task: str = "classification_binary",
    split: str = "data_split",
    group: str = "group",
    y: str = "y",
    y_pred: str = "y_pred",
    prob: str = "y_pred_prob",
) -> DataFrame:
    """All metrics per (group, split) and, under a blank group, per split."""
    keys = [group, split]
    if task == "regression":
        return regression_metrics(with_overall(df, group), keys, y, y_pred)
    # The source, which may be a whole scoring run, is read once: every metric
    # follows from the rows per (group, split, prediction, score).
    own_keys = [split, *([group] if group in df.columns else [])]
    predicted = _checked(F.col(y_pred).cast("double"), y_pred)
    counted = cut_lineage(
        score_counts(df.withColumn("_pred", predicted), [*own_keys, "_pred"], y, prob)
    )
    tables = with_overall(counted, group)
    cell = lambda p, n: F.sum(F.when(F.col("_pred") == p, F.col(n)).otherwise(F.lit(0)))
    confusion = (
        tables.groupBy(*keys)
        .agg(
            cell(1, "pos").alias("tp"),
            cell(1, "neg").alias("fp"),
            cell(0, "neg").alias("tn"),
            cell(0, "pos").alias("fn"),
            F.sum(F.col("pos") + F.col("neg")).alias("total"),
        )
        .withColumn("tp+tn", F.col("tp") + F.col("tn"))
    )
    scores = tables.groupBy(*keys, "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    table = classification_metrics(confusion)
    for more in (roc_auc_from_counts(scores, keys), optimal_cutoff_from_counts(scores, keys)):
        table = join_same(table, more, keys, "left")
    return table


def metric_names_long(
    stats: DataFrame,
    metrics: list[str],
    split: str = "data_split",
    group: str = "group",
) -> DataFrame:
    """(metric, value) rows named ``split.group.metric``, blanks skipped."""
    long = stats.select(split, group, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [split, group], list(metrics), "_m", "value"
    )
    parts = [F.nullif(F.col(c), F.lit("")) for c in (split, group, "_m")]
    return long.select(F.concat_ws(".", *parts).alias("metric"), "value")


def group_label_stats(
    df: DataFrame, group: str = "group", y: str = "y", y_pred: str = "y_pred"
) -> DataFrame:
    """Legend text per group: rows and Spearman, ``N/A`` up to 2 rows."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    joined = join_same(counts, spearman(df, [group], y, y_pred), [group], "left")
    shown = F.when(
        (F.col("n") > 2) & F.col("spearman_r").isNotNull(),
        F.format_string("%.2f", F.col("spearman_r")),
    ).when(F.col("n") > 2, F.lit("nan")).otherwise(F.lit("N/A"))
    label = F.concat(
        F.col(group), F.lit(" (n="), F.col("n").cast("string"), F.lit(", sp_r="), shown, F.lit(")")
    )
    return joined.select(group, "n", "spearman_r", label.alias("label"))
