"""Metrics, curves, histograms and pairwise diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, histograms, metrics, pairs
from . import scoring_sql as s
from . import views as v
from .registry import query

KEYS = ["data_split", "group"]


@query(
    "confusion_counts",
    s.CLASSIFICATION_SQL
    + """SELECT data_split, "group", tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn,
      (tp + tn)::BIGINT AS "tp+tn", total FROM metrics WHERE "group" <> ''""",
)
def confusion_counts(spark, sf_dir):
    return metrics.confusion_counts(v.scored_events(spark, sf_dir), KEYS)


_NAMES = ("accuracy", "precision", "recall", "specificity", "f_score", "matthews_corr_coef", "balanced_accuracy")


def _rounded(names):
    return [v.r6(F.col(n)).alias(n) for n in names]


def _rounded_sql(names):
    return ", ".join(f'{v.sql_r6(n)} AS {n}' for n in names)


@query(
    "classification_metrics",
    s.CLASSIFICATION_SQL + f"""SELECT data_split, "group", {_rounded_sql(_NAMES)} FROM metrics WHERE "group" <> '' """,
)
def classification_metrics(spark, sf_dir):
    counts = metrics.confusion_counts(v.scored_events(spark, sf_dir), KEYS)
    return metrics.classification_metrics(counts).select(*KEYS, *_rounded(_NAMES))


@query(
    "roc_auc",
    f"""WITH {v.SCORED}, {s.GROUPED}, {s.AUC}
    SELECT data_split, "group", {v.sql_r6('roc_auc_score')} AS roc_auc_score FROM auc WHERE "group" <> '' """,
)
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(v.scored_events(spark, sf_dir), KEYS).select(*KEYS, *_rounded(["roc_auc_score"]))


@query(
    "optimal_cutoff",
    f"""WITH {v.SCORED}, {s.GROUPED}, {s.CUTOFF}
    SELECT data_split, "group", optimal_mcc_cutoff, {v.sql_r6('optimal_mcc')} AS optimal_mcc
    FROM best WHERE rn = 1 AND "group" <> '' """,
)
def optimal_cutoff(spark, sf_dir):
    best = metrics.optimal_cutoff(v.scored_events(spark, sf_dir), KEYS)
    return best.select(*KEYS, "optimal_mcc_cutoff", *_rounded(["optimal_mcc"]))


@query(
    "regression_metrics",
    s.REGRESSION_SQL
    + f"""SELECT data_split, "group", n_rows, {_rounded_sql(metrics.REGRESSION_METRICS)} FROM stats WHERE "group" <> '' """,
)
def regression_metrics(spark, sf_dir):
    df = metrics.regression_metrics(v.regression_events(spark, sf_dir), KEYS)
    return df.select(*KEYS, "n_rows", *_rounded(metrics.REGRESSION_METRICS))


_ALL_METRICS_SQL = (
    f"WITH {v.SCORED}, {s.GROUPED}, {s.CONFUSION}, {s.METRICS}, {s.AUC}, {s.CUTOFF}, "
    """everything AS (SELECT * FROM metrics JOIN auc USING (data_split, "group")
      JOIN (SELECT * FROM best WHERE rn = 1) USING (data_split, "group")) """
)


@query(
    "metrics_by_split_group",
    _ALL_METRICS_SQL
    + f"""SELECT data_split, "group", tp::BIGINT AS tp, total, {_rounded_sql(metrics.CLASSIFICATION_METRICS)} FROM everything""",
)
def metrics_by_split_group(spark, sf_dir):
    df = metrics.metrics_by_split_group(v.scored_events(spark, sf_dir))
    return df.select(*KEYS, "tp", "total", *_rounded(metrics.CLASSIFICATION_METRICS))


@query(
    "regression_by_split_group",
    s.REGRESSION_SQL
    + f"""SELECT data_split, "group", n_rows, {_rounded_sql(metrics.REGRESSION_METRICS)} FROM stats""",
)
def regression_by_split_group(spark, sf_dir):
    df = metrics.metrics_by_split_group(v.regression_events(spark, sf_dir), "regression")
    return df.select(*KEYS, "n_rows", *_rounded(metrics.REGRESSION_METRICS))


@query(
    "metric_names_long",
    s.CLASSIFICATION_SQL
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT concat_ws('.', data_split, nullif("group", ''), '{n}') AS metric, {v.sql_r6(n)} AS value FROM metrics"""
        for n in ("accuracy", "recall", "matthews_corr_coef")
    )
    + ")",
)
def metric_names_long(spark, sf_dir):
    df = metrics.metrics_by_split_group(v.scored_events(spark, sf_dir))
    long = metrics.metric_names_long(df, ["accuracy", "recall", "matthews_corr_coef"])
    return long.select("metric", v.r6(F.col("value")).alias("value"))


@query(
    "group_label_stats",
    f"""WITH {v.REGRESSION}, rgrouped AS (SELECT 'all' AS data_split, "group", y, y_pred FROM reg), {s.SPEARMAN},
    st AS (SELECT "group", count(*) AS n, CASE WHEN count(*) > 2 THEN corr(ry, rp) END AS sp FROM ranks GROUP BY "group")
    SELECT "group", n, {v.sql_r6('sp')} AS spearman_r,
      "group" || ' (n=' || n || ', sp_r=' || CASE WHEN n > 2 THEN printf('%.2f', sp) ELSE 'N/A' END || ')' AS label FROM st""",
)
def group_label_stats(spark, sf_dir):
    df = metrics.group_label_stats(v.regression_events(spark, sf_dir))
    return df.select("group", "n", v.r6(F.col("spearman_r")).alias("spearman_r"), "label")


@query(
    "confusion_matrix",
    f"""WITH {v.SCORED}, cells AS (SELECT a.c AS actual, p.c AS predicted FROM (VALUES (0), (1)) a(c), (VALUES (0), (1)) p(c)),
    n AS (SELECT actual, predicted, (SELECT count(*) FROM scored WHERE y = actual AND y_pred = predicted) AS n FROM cells)
    SELECT actual, predicted, n, {v.sql_r6('coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY actual), 0), 0)')} AS share FROM n""",
)
def confusion_matrix(spark, sf_dir):
    df = curves.confusion_matrix(v.scored_events(spark, sf_dir))
    return df.select("actual", "predicted", "n", v.r6(F.col("share")).alias("share"))


_CURVE = f"""WITH {v.SCORED}, c AS (
  SELECT data_split, y_pred_prob AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL),
cum AS (SELECT data_split, threshold, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
  sum(pos) OVER (PARTITION BY data_split) AS tp, sum(neg) OVER (PARTITION BY data_split) AS tn
  FROM c WINDOW w AS (PARTITION BY data_split ORDER BY threshold DESC)) """


@query(
    "roc_points",
    _CURVE
    + f"""SELECT data_split, {v.sql_r6('threshold')} AS threshold, {v.sql_r6('cn::DOUBLE / tn')} AS fpr,
      {v.sql_r6('cp::DOUBLE / tp')} AS tpr FROM cum""",
)
def roc_points(spark, sf_dir):
    df = curves.roc_points(v.scored_events(spark, sf_dir), ["data_split"])
    return df.select("data_split", *_rounded(["threshold", "fpr", "tpr"]))


@query(
    "pr_points",
    _CURVE
    + f"""SELECT data_split, {v.sql_r6('threshold')} AS threshold, {v.sql_r6('cp::DOUBLE / (cp + cn)')} AS precision,
      {v.sql_r6('cp::DOUBLE / tp')} AS recall FROM cum
    UNION ALL SELECT DISTINCT data_split, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM cum""",
)
def pr_points(spark, sf_dir):
    df = curves.pr_points(v.scored_events(spark, sf_dir), ["data_split"])
    return df.select("data_split", *_rounded(["threshold", "precision", "recall"]))


@query(
    "target_histogram",
    f"""WITH {v.REGRESSION}, used AS (SELECT * FROM reg WHERE data_split IN ('train', 'test')),
    r AS (SELECT data_split, min(y) AS lo, max(y) AS hi, count(*) AS total FROM used GROUP BY data_split),
    b AS (SELECT data_split, least(floor((y - lo) / ((hi - lo) / 20.0::DOUBLE)), 19)::INT AS bin, lo, hi, total
      FROM used JOIN r USING (data_split))
    SELECT data_split, bin, {v.sql_r6('lo + bin * ((hi - lo) / 20.0::DOUBLE)')} AS bin_start, count(*) AS n,
      {v.sql_r6('count(*) / (total * ((hi - lo) / 20.0::DOUBLE))')} AS density
    FROM b GROUP BY data_split, bin, lo, hi, total""",
)
def target_histogram(spark, sf_dir):
    df = histograms.target_histogram(v.regression_events(spark, sf_dir))
    return df.select(
        "data_split", "bin", v.r6(F.col("bin_start")).alias("bin_start"), "n", v.r6(F.col("density")).alias("density")
    )


# -- pairs ---------------------------------------------------------------------

_BENCH = f"""bench AS (
  SELECT DISTINCT CASE WHEN item_id % 4 = 0 THEN 'test' ELSE 'train' END AS side,
    {v.SQL_SEQUENCE.format(text='text')} AS s FROM benchmark)"""

def _lcs_sql(select: str) -> str:
    """All pairs of the passages with their LCS: one recursive step per letter of the first."""
    return f"""WITH RECURSIVE {_BENCH}, pairs AS (
      SELECT row_number() OVER () AS id, a.side AS side_a, b.side AS side_b, a.s AS a, b.s AS b,
        string_split(a.s, '') AS la, string_split(b.s, '') AS lb FROM bench a, bench b
      WHERE (a.side = b.side AND a.s <= b.s) OR (a.side = 'train' AND b.side = 'test')),
    steps AS (
      SELECT id, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0::BIGINT) AS r FROM pairs
      UNION ALL
      SELECT s.id, s.i + 1, list_reduce(
          range(1, length(p.b) + 1),
          lambda acc, j: list_append(acc, CASE WHEN p.lb[j] = p.la[s.i + 1] THEN s.r[j] + 1
            ELSE greatest(acc[j], s.r[j + 1]) END),
          [0::BIGINT])
      FROM steps s JOIN pairs p USING (id) WHERE s.i < length(p.a)),
    ratios AS (
      SELECT p.*, CASE WHEN side_a = side_b THEN side_a || '_' || side_b ELSE 'train_test' END AS pair_set,
        2.0::DOUBLE * s.r[length(p.b) + 1] / (length(p.a) + length(p.b)) AS ratio
      FROM steps s JOIN pairs p USING (id) WHERE s.i = length(p.a))
    {select}"""


# The passages' median identity lies near this value.
_MIN_IDENTITY = 0.5


@query(
    "sequence_identity_pairs",
    _lcs_sql(
        f"""SELECT pair_set, md5(a) AS digest_a, md5(b) AS digest_b, {v.sql_r6('ratio')} AS ratio
        FROM ratios WHERE ratio >= {_MIN_IDENTITY}::DOUBLE"""
    ),
)
def sequence_identity_pairs(spark, sf_dir):
    df = pairs.sequence_identity_pairs(v.benchmark_sequences(spark, sf_dir), _MIN_IDENTITY)
    return df.select(
        "pair_set",
        F.md5("sequence_a").alias("digest_a"),
        F.md5("sequence_b").alias("digest_b"),
        v.r6(F.col("ratio")).alias("ratio"),
    )


@query(
    "sequence_identity_histogram",
    _lcs_sql(
        """SELECT pair_set, least(floor(ratio * 20), 19)::INT AS bin, count(*) AS n FROM ratios
        WHERE ratio > 0 OR side_a <> side_b GROUP BY ALL"""
    ),
)
def sequence_identity_histogram(spark, sf_dir):
    return pairs.sequence_identity_histogram(v.benchmark_sequences(spark, sf_dir))


@query("near_identical_join")
def near_identical_join(spark, sf_dir):
    return pairs.near_identical_join(v.sequences(spark, sf_dir))


_COSINES = f"""WITH {v.VECTORS}, used AS (SELECT * FROM vectors WHERE data_split IN ('train', 'test')),
sims AS (
  SELECT a.data_split AS sa, b.data_split AS sb, a.seq_id AS ia, b.seq_id AS ib,
    list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding))
      * sqrt(list_dot_product(b.embedding, b.embedding))) AS sim
  FROM used a, used b WHERE a.data_split = b.data_split OR (a.data_split = 'train' AND b.data_split = 'test'))"""

_MIN_COSINE = 0.5


@query(
    "cosine_similarity_pairs",
    _COSINES
    + f""" SELECT CASE WHEN sa = sb THEN sa || '_' || sb ELSE 'train_test' END AS pair_set, ia AS id_a, ib AS id_b,
      {v.sql_r6('sim')} AS similarity
    FROM sims WHERE sim >= {_MIN_COSINE}::DOUBLE - 1e-12 AND (sa <> sb OR ia <= ib)""",
)
def cosine_similarity_pairs(spark, sf_dir):
    df = pairs.cosine_similarity_pairs(v.vectors(spark, sf_dir), "seq_id", _MIN_COSINE)
    return df.select("pair_set", "id_a", "id_b", v.r6(F.col("similarity")).alias("similarity"))


@query(
    "cosine_similarity_histogram",
    _COSINES
    + """ SELECT CASE WHEN sa = sb THEN sa || '_' || sb ELSE 'train_test' END AS pair_set,
      least(floor(round(sim, 12) * 20), 19)::INT AS bin, count(*) AS n
    FROM sims WHERE round(sim, 12) BETWEEN 0 AND 1 GROUP BY ALL""",
)
def cosine_similarity_histogram(spark, sf_dir):
    return pairs.cosine_similarity_histogram(v.vectors(spark, sf_dir), "seq_id")
