"""Encoders, scalers, features, the attention scorer, ensembles and training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.constants import ALPHABET, POOL_MODES
from ..operators import attention, ensemble, features, gradient, linear, residues, scalers
from ..operators.attention import models_from_table, models_to_table
from ..operators.dimred import apply_pca, fit_pca, pca_scatter_points
from ..operators.metrics import argmax_first, confusion_counts
from ..plans.inference import score_sequences
from ..plans.pipeline import (
    FittedPipeline,
    PipelineConfig,
    compose_pipeline,
    load_pipeline,
    save_pipeline,
)
from ..session import scratch_path
from . import scoring_sql as s
from . import views as v
from .registry import SQL, query



def _located(rows):
    """Each residue column's mean and position-weighted mean per sequence."""
    names = [c for c in rows.columns if c not in ("seq_id", "pos")]
    place = (F.col("pos") + 1) / F.lit(1000.0)
    return rows.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[v.r6(F.avg(c)).alias(c) for c in names],
        *[v.r6(F.avg(F.col(c) * place)).alias(f"{c}_placed") for c in names],
    )


def _located_sql(table: str, names: list[str]) -> str:
    columns = [f"{v.sql_r6(f'avg({c})')} AS {c}" for c in names]
    columns += [f"{v.sql_r6(f'avg({c} * ((pos + 1) / 1000.0::DOUBLE))')} AS {c}_placed" for c in names]
    return f"SELECT seq_id, count(*) AS n, {', '.join(columns)} FROM {table} GROUP BY seq_id"


# -- residues and encoders -----------------------------------------------------


@query(
    "residue_explode",
    f"""WITH {v.RESIDUES} SELECT seq_id, aa, count(*) AS n, sum(pos)::BIGINT AS pos_sum,
      sum((aa IN ('V','I','L','F','Y','W','M'))::INT)::BIGINT AS n_positive FROM residues GROUP BY seq_id, aa""",
)
def residue_explode(spark, sf_dir):
    df = v.sequences(spark, sf_dir).select("seq_id", "sequence")
    labeled = df.withColumn("labels", v.residue_labels(F.col("sequence")))
    rows = residues.residue_explode(labeled, "labels").select("seq_id", "pos", "aa", "res_value_bool")
    return rows.groupBy("seq_id", "aa").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("pos").alias("pos_sum"),
        F.sum("res_value_bool").alias("n_positive"),
    )


@query(
    "encode_onehot",
    f"WITH {v.RESIDUES} SELECT seq_id, "
    + ", ".join(f"sum((aa = '{a}')::INT)::DOUBLE AS n_{a}" for a in ALPHABET)
    + " FROM residues GROUP BY seq_id",
)
def encode_onehot(spark, sf_dir):
    """One-hot vectors of every residue, added up per sequence."""
    rows = residues.residue_explode(v.sequences(spark, sf_dir).select("seq_id", "sequence"))
    encoded = residues.encode_onehot(rows.select("seq_id", "aa"))
    return encoded.groupBy("seq_id").agg(
        *[F.sum(F.col("vec")[i]).alias(f"n_{a}") for i, a in enumerate(ALPHABET)]
    )


@query(
    "encode_zscale",
    f"WITH {v.RESIDUES}, {v.ZBOOK}, encoded AS (SELECT * FROM residues JOIN zbook USING (aa)) "
    + _located_sql("encoded", ["d0", "d1", "d2", "d3", "d4"]),
)
def encode_zscale(spark, sf_dir):
    rows = residues.residue_explode(v.sequences(spark, sf_dir).select("seq_id", "sequence"))
    encoded = residues.encode_zscale(rows.select("seq_id", "pos", "aa"))
    return _located(encoded.select("seq_id", "pos", *[F.col("vec")[i].alias(f"d{i}") for i in range(5)]))


@query(
    "mean_pool",
    f"WITH {v.RESIDUES}, {v.ZBOOK} SELECT seq_id, "
    + ", ".join(f"{v.sql_r6(f'avg(d{i})')} AS m{i}" for i in range(5))
    + " FROM residues JOIN zbook USING (aa) GROUP BY seq_id",
)
def mean_pool(spark, sf_dir):
    df = v.sequences(spark, sf_dir).where(F.length("sequence") > 0)
    pooled = df.withColumn("m", residues.mean_pool_letters(F.col("sequence"), "zscale"))
    return pooled.select("seq_id", *[v.r6(F.col("m")[i]).alias(f"m{i}") for i in range(5)])


@query(
    "attach_embeddings",
    """WITH dims AS (SELECT unnest(range(64)) AS dim)
    SELECT d.doc_id AS seq_id, dim::INT AS dim, e.embedding[dim + 1]::DOUBLE AS value
    FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id, dims
    UNION ALL
    SELECT doc_id, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
)
def attach_embeddings(spark, sf_dir):
    """Every dimension of the matched rows; one row without value for the others."""
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"))
    joined, missing = features.attach_embeddings(docs, v.table(spark, sf_dir, "embeddings"), "seq_id", "vec_id")
    found = joined.select("seq_id", F.posexplode("embedding").alias("dim", "value"))
    found = found.withColumn("value", F.col("value").cast("double"))
    return found.unionByName(missing, allowMissingColumns=True)


@query(
    "attach_residue_embeddings",
    f"""WITH {v.SEQS}, places AS (SELECT unnest(range(8)) AS pos)
    SELECT s.seq_id, pos::INT AS pos, {v.sql_r6("list_sum(e.embedding[8 * pos + 1 : 8 * pos + 8])")} AS total
    FROM seqs s JOIN embeddings e ON s.seq_id = e.vec_id, places WHERE pos < length(s.sequence)""",
)
def attach_residue_embeddings(spark, sf_dir):
    """The 64 values as 8 residue vectors in the last of two layers, cut to the sequence."""
    residue = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", 8 * i + 1, 8))
    stacks = v.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array(F.array(), residue.cast("array<array<double>>")).alias("layers")
    )
    docs = v.sequences(spark, sf_dir).select("seq_id", "sequence")
    joined, _ = features.attach_embeddings(
        docs, stacks, "seq_id", "vec_id", "layers", layer=-1, n_layers=2,
        cut_to=F.least(F.length("sequence"), F.lit(8)),
    )
    rows = joined.select("seq_id", F.posexplode("embedding").alias("pos", "vec"))
    return rows.select("seq_id", "pos", v.r6(arrays.array_sum(F.col("vec"))).alias("total"))


# -- scalers and features ------------------------------------------------------

_TRAIN = "train AS (SELECT * FROM ev WHERE data_split = 'train')"
_EV = f"ev AS (SELECT event_id, value, user_id::DOUBLE AS usr, {v.sql_split('user_id')} AS data_split FROM events)"


def _events(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select(
        "event_id",
        "value",
        F.col("user_id").cast("double").alias("usr"),
        v.split_of(F.col("user_id")).alias("data_split"),
    )


def _scaled(spark, sf_dir, fit):
    df = _events(spark, sf_dir)
    scaler = fit(df.where(F.col("data_split") == "train"), ["value", "usr"])
    return scaler.apply(df).select("event_id", v.r6(F.col("value")).alias("value"), v.r6(F.col("usr")).alias("usr"))


def _scaled_sql(center: str, scale: str, stretch: float = 1.0, shift: float = 0.0) -> str:
    params = ", ".join(
        f"{center.format(x=c)} AS c_{c}, coalesce(nullif({scale.format(x=c)}, 0), 1) AS s_{c}" for c in ("value", "usr")
    )
    columns = ", ".join(
        v.sql_r6(f"({c} - c_{c}) / s_{c} * {stretch!r}::DOUBLE + {shift!r}::DOUBLE") + f" AS {c}" for c in ("value", "usr")
    )
    return f"WITH {_EV}, {_TRAIN}, p AS (SELECT {params} FROM train) SELECT event_id, {columns} FROM ev, p"


@query(
    "fit_robust_scaler",
    _scaled_sql("quantile_cont({x}, 0.5)", "(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))"),
)
def fit_robust_scaler(spark, sf_dir):
    return _scaled(spark, sf_dir, scalers.fit_robust_scaler)


@query("fit_minmax_scaler", _scaled_sql("min({x})", "(max({x}) - min({x}))", 2.0, -1.0))
def fit_minmax_scaler(spark, sf_dir):
    return _scaled(spark, sf_dir, scalers.fit_minmax_scaler)


@query("fit_standard_scaler", _scaled_sql("avg({x})", "stddev_pop({x})"))
def fit_standard_scaler(spark, sf_dir):
    return _scaled(spark, sf_dir, scalers.fit_standard_scaler)


@query(
    "scale_target",
    f"""WITH {_EV}, {_TRAIN}, p AS (SELECT min(value) AS lo, max(value) AS hi FROM train)
    SELECT event_id, {v.sql_r6('(value - lo) / (hi - lo)')} AS y_scaled FROM ev, p""",
)
def scale_target(spark, sf_dir):
    df = _events(spark, sf_dir).withColumnRenamed("value", "y")
    scaler = scalers.fit_target_scaler(df.where(F.col("data_split") == "train"), "MinMaxScaler")
    return scalers.scale_target(df, scaler).select("event_id", v.r6(F.col("y_scaled")).alias("y_scaled"))


@query(
    "restore_target",
    f"""WITH {_EV}, {_TRAIN}, p AS (SELECT quantile_cont(value, 0.5) AS m,
       quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS s FROM train)
    SELECT event_id, {v.sql_r6('((value - m) / s + 0.25::DOUBLE) * s + m')} AS y_pred FROM ev, p""",
)
def restore_target(spark, sf_dir):
    """Scaled targets shifted by a quarter stand in for predictions."""
    df = _events(spark, sf_dir).withColumnRenamed("value", "y")
    scaler = scalers.fit_target_scaler(df.where(F.col("data_split") == "train"), "RobustScaler")
    shifted = scalers.scale_target(df, scaler).withColumn("y_pred", F.col("y_scaled") + 0.25)
    return scalers.restore_target(shifted, scaler).select("event_id", v.r6(F.col("y_pred")).alias("y_pred"))


@query(
    "standardize_embeddings",
    f"""WITH {v.VECTORS}, long AS (
      SELECT seq_id, data_split, unnest(range(64)) AS dim, unnest(embedding) AS x FROM vectors),
    p AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM long WHERE data_split = 'train' GROUP BY dim)
    SELECT seq_id, dim::INT AS dim, {v.sql_r6('(x - m) / coalesce(nullif(s, 0), 1)')} AS x FROM long JOIN p USING (dim)""",
)
def standardize_embeddings(spark, sf_dir):
    df = v.vectors(spark, sf_dir)
    scaler = scalers.fit_vector_scaler(df.where(F.col("data_split") == "train"), "embedding")
    scaled = scalers.standardize_embeddings(df, "embedding", scaler)
    return scaled.select("seq_id", F.posexplode("embedding").alias("dim", "x")).select(
        "seq_id", "dim", v.r6(F.col("x")).alias("x")
    )


@query(
    "rbf_expand",
    f"""WITH {_EV}, {_TRAIN}, p AS (SELECT min(value) AS lo, max(value) AS hi FROM train),
    z AS (SELECT event_id, (value - lo) / (hi - lo) * 2 - 1 AS x FROM ev, p)
    SELECT event_id, """
    + ", ".join(
        v.sql_r6(f"exp(-pow((x - ({c!r}::DOUBLE)) / 0.2::DOUBLE, 2))") + f" AS k{i}"
        for i, c in enumerate(features.rbf_centers(-1.0, 1.0, 10))
    )
    + " FROM z",
)
def rbf_expand(spark, sf_dir):
    df = _events(spark, sf_dir)
    scaler = scalers.fit_minmax_scaler(df.where(F.col("data_split") == "train"), ["value"])
    expanded = scaler.apply(df).withColumn("k", features.rbf_expand(F.col("value")))
    return expanded.select("event_id", *[v.r6(F.col("k")[i]).alias(f"k{i}") for i in range(10)])


@query(
    "encode_categorical",
    """WITH cats AS (SELECT event_type AS cat, row_number() OVER (ORDER BY event_type) - 1 AS i
       FROM (SELECT DISTINCT event_type FROM events WHERE user_id % 10 < 8))
    SELECT event_id, i::INT AS hot, 1.0::DOUBLE AS total, (SELECT count(*) FROM cats)::INT AS width
    FROM events JOIN cats ON event_type = cat""",
)
def encode_categorical(spark, sf_dir):
    df = v.featured_events(spark, sf_dir)
    encoder = features.fit_categorical(df.where(F.col("data_split") == "train"), "data_type")
    encoded = encoder.attach(df, "index").withColumn("vec", encoder.sparse(F.col("index")))
    return encoded.select(
        "event_id",
        F.col("vec.indices")[0].cast("int").alias("hot"),
        F.aggregate("vec.values", F.lit(0.0), lambda a, b: a + b).alias("total"),
        F.col("vec.size").cast("int").alias("width"),
    )


@query(
    "assemble_features",
    f"""WITH {v.RESIDUES}, {v.ZBOOK}, pooled AS (
      SELECT seq_id, [{", ".join(f"avg(d{i})" for i in range(5))}] AS m, count(*) AS len
      FROM residues JOIN zbook USING (aa) GROUP BY seq_id),
    full_rows AS (
      SELECT p.seq_id, list_concat(m, list_concat(coalesce(e.embedding, list_transform(range(64), lambda x: NULL::FLOAT))::DOUBLE[],
        [len::DOUBLE])) AS f
      FROM pooled p LEFT JOIN embeddings e ON p.seq_id = e.vec_id)
    SELECT seq_id, i::INT AS i, {v.sql_r6("f[i + 1]")} AS value FROM full_rows, (SELECT unnest(range(70)) AS i)""",
)
def assemble_features(spark, sf_dir):
    """All 70 values; documents without a vector keep their place with missing values."""
    docs = v.sequences(spark, sf_dir).where(F.length("sequence") > 0)
    vectors = v.table(spark, sf_dir, "embeddings")
    joined, missing = features.attach_embeddings(docs, vectors, "seq_id", "vec_id")
    rest = docs.join(missing, "seq_id", "left_semi").withColumn(
        "embedding", F.array_repeat(F.lit(None).cast("float"), 64)
    )
    parts = features.assemble_features(
        residues.mean_pool_letters(F.col("sequence"), "zscale"),
        F.col("embedding"),
        F.array(F.length("sequence")),
    )
    rows = joined.unionByName(rest).select("seq_id", F.posexplode(parts).alias("i", "value"))
    return rows.withColumn("value", v.r6(F.col("value")))


# -- attention scorer ----------------------------------------------------------

_ONE = range(1, 2)


def _first_fold():
    return v.fold_models(folds=1)[0]


def _convolved(spark, sf_dir):
    df = v.sequences(spark, sf_dir).select("seq_id", "sequence")
    return attention.residue_conv1d(df, _first_fold())


@query(
    "residue_conv1d",
    "WITH "
    + s.CONTEXT
    + s.convolved(_ONE)
    + " "
    + _located_sql("conv", ["f1_0", "f1_1", "a1_0", "a1_1"]),
)
def residue_conv1d(spark, sf_dir):
    both = F.arrays_zip("features", "attention")
    rows = _convolved(spark, sf_dir).select("seq_id", F.posexplode(both).alias("pos", "z"))
    channels = [
        F.col(f"z.{part}")[k].alias(f"{part[0]}1_{k}")
        for part in ("features", "attention")
        for k in range(2)
    ]
    return _located(rows.select("seq_id", "pos", *channels))


@query(
    "attention_apply",
    "WITH "
    + s.CONTEXT
    + s.convolved(_ONE)
    + s.applied(_ONE)
    + ", scaled AS (SELECT seq_id, pos, x1_0 * 1000 AS x0, x1_1 * 1000 AS x1 FROM applied) "
    + _located_sql("scaled", ["x0", "x1"]),
)
def attention_apply(spark, sf_dir):
    applied = attention.attention_apply(_convolved(spark, sf_dir))
    rows = applied.select("seq_id", F.posexplode("applied").alias("pos", "x"))
    return _located(
        rows.select("seq_id", "pos", *[(F.col("x")[k] * 1000).alias(f"x{k}") for k in range(2)])
    )


@query(
    "mlp_head",
    "WITH "
    + s.CONTEXT
    + s.convolved(_ONE)
    + s.applied(_ONE)
    + s.heads(_ONE)
    + " "
    + _located_sql("heads", ["o1"]),
)
def mlp_head(spark, sf_dir):
    applied = attention.attention_apply(_convolved(spark, sf_dir))
    logits = attention.mlp_head(applied.drop("features", "attention"), _first_fold().head)
    return _located(logits.select("seq_id", F.posexplode("logits").alias("pos", "o1")))


_LETTER_LOGITS = (
    v.RESIDUES
    + ", "
    + v.sql_codebook("logits", {a: [x] for a, x in v.letter_logit_values().items()})
    + """, o AS (SELECT seq_id, d0 AS o, 1.0::DOUBLE / (1.0::DOUBLE + exp(-d0)) AS p FROM residues JOIN logits USING (aa))"""
)

# Temperature of the pooling queries.
_TEMPERATURE = 1.3

_POOL_SQL = {
    "max": "max(p)",
    "mean": "avg(p)",
    "mean_single_conv": "avg(p)",
    "sum": "1.0::DOUBLE / (1.0::DOUBLE + exp(-sum(o)))",
    "weighted_mean": "sum(p * exp(p)) / sum(exp(p))",
    "weighted_mean_single_conv": "sum(p * exp(p)) / sum(exp(p))",
    "weighted_mean_two": "least(sum(p * exp(o)) / sum(exp(o)), 1.0::DOUBLE)",
    "weighted_mean_three": f"least(sum(p * exp(o / {_TEMPERATURE}::DOUBLE)) / sum(exp(o / {_TEMPERATURE}::DOUBLE)), 1.0::DOUBLE)",
}


def _letter_logit_rows(spark, sf_dir):
    df = v.sequences(spark, sf_dir).where(F.length("sequence") > 0)
    return df.select("seq_id", v.letter_logits(F.col("sequence")).alias("logits"))


def _register_pool(mode: str) -> None:
    @query(
        f"pool_{mode}",
        f"WITH {_LETTER_LOGITS} SELECT seq_id, {v.sql_r6(_POOL_SQL[mode])} AS score FROM o GROUP BY seq_id",
    )
    def pool(spark, sf_dir):
        score = arrays.pool_scores(mode, F.col("logits"), _TEMPERATURE)
        return _letter_logit_rows(spark, sf_dir).select("seq_id", v.r6(score).alias("score"))


for _mode in POOL_MODES:
    _register_pool(_mode)


@query(
    "score_penalty",
    f"WITH {_LETTER_LOGITS} SELECT seq_id, {v.sql_r6('1000 * ' + _POOL_SQL['weighted_mean_three'] + ' / count(*) * 0.1::DOUBLE')} AS penalty FROM o GROUP BY seq_id",
)
def score_penalty(spark, sf_dir):
    penalty = attention.score_penalty(F.col("logits"), "weighted_mean_three", 0.1, _TEMPERATURE)
    return _letter_logit_rows(spark, sf_dir).select("seq_id", v.r6(penalty * 1000).alias("penalty"))


@query("score_folds", s.FOLD_SCORES + s.folds_wide_sql(""))
def score_folds(spark, sf_dir):
    """All five folds, with weights that go through the weights table."""
    weights = models_to_table(spark, v.fold_models(), "formula")
    models = models_from_table(weights, "formula")
    df = v.sequences(spark, sf_dir)
    scored = attention.score_folds(df, models, "weighted_mean_three", with_residues=False)
    return scored.where(F.col("ensemble_score").isNotNull()).select(
        "name",
        *[v.r6(F.col("fold_scores")[f]).alias(f"{f}_seq_score") for f in v.FOLDS],
        v.r6(F.col("ensemble_score")).alias("ensemble_seq_score"),
    )


def _scored(spark, sf_dir, fold_residues=False):
    return _scored_rows(v.sequences(spark, sf_dir), fold_residues)


def _scored_rows(df, fold_residues=False):
    # Empty sequences have no score; asking for it afterwards keeps the text
    # clean-up out of a filter that would run in the lone scan task.
    scored = score_sequences(df, v.fold_models(), fold_residues=fold_residues)
    return scored.where(F.col("ensemble_score").isNotNull())


def _sequence_scores(spark, sf_dir):
    df = v.sequences(spark, sf_dir)
    scored = attention.score_folds(df, v.fold_models(), "weighted_mean_three", with_residues=False)
    return scored.where(F.col("ensemble_score").isNotNull())


_LONG_SCORES = " UNION ALL ".join(
    f"SELECT seq_id, 'fold{f}' AS fold, s{f} AS score, {v.CUTOFFS[f'fold{f}']!r}::DOUBLE + 0.11::DOUBLE AS cutoff FROM seq_scores" for f in range(1, 6)
)


@query(
    "apply_cutoff",
    s.FOLD_SCORES + f"SELECT seq_id, fold, (score >= cutoff)::INT AS y_pred FROM ({_LONG_SCORES})",
)
def apply_cutoff(spark, sf_dir):
    cutoffs = {f: c + 0.11 for f, c in v.CUTOFFS.items()}
    long = attention.fold_scores_long(_sequence_scores(spark, sf_dir), cutoffs)
    return long.select("seq_id", "fold", "y_pred")


# -- ensembles -----------------------------------------------------------------


@query(
    "ensemble_sequence",
    s.FOLD_SCORES + f"SELECT seq_id, {v.sql_r6(s.ENSEMBLE)} AS ensemble_score, 5 AS n_folds FROM seq_scores",
)
def ensemble_sequence(spark, sf_dir):
    long = attention.fold_scores_long(_sequence_scores(spark, sf_dir))
    means = ensemble.ensemble_sequence(long)
    return means.select("seq_id", v.r6(F.col("ensemble_score")).alias("ensemble_score"), F.col("n_folds").cast("int").alias("n_folds"))


@query(
    "ensemble_residue",
    s.FOLD_SCORES
    + f", means AS (SELECT seq_id, pos, {s.ENSEMBLE_RESIDUE} AS score FROM probs) "
    + _located_sql("means", ["score"]),
)
def ensemble_residue(spark, sf_dir):
    """Folds are averaged inside the row; only rows that share an id meet by position."""
    once, again = ensemble.split_repeated(v.sequences(spark, sf_dir))
    means = ensemble.ensemble_residue(_scored_rows(once, True), v.FOLDS, distinct_ids=True)
    if again is not None:
        means = means.unionByName(ensemble.ensemble_residue(_scored_rows(again, True), v.FOLDS))
    return _located(means)


_RISK = "p > 0.55::DOUBLE"
_LETTER_RESIDUES = (
    v.RESIDUES
    + ", "
    + v.sql_codebook("logits", {a: [x] for a, x in v.letter_logit_values().items()})
    + """, scores AS (
  SELECT seq_id, pos, 1.0::DOUBLE / (1.0::DOUBLE + exp(-d0)) AS p FROM residues JOIN logits USING (aa))"""
)


def _letter_scores(spark, sf_dir):
    rows = _letter_logit_rows(spark, sf_dir).select("seq_id", F.posexplode("logits").alias("pos", "o"))
    return rows.select("seq_id", "pos", arrays.sigmoid(F.col("o")).alias("score"))


@query(
    "residue_summary",
    f"""WITH {_LETTER_RESIDUES} SELECT seq_id, {v.sql_r6('avg(p)')} AS mean, {v.sql_r6('max(p)')} AS max,
      {v.sql_r6('min(p)')} AS min, count(*) FILTER ({_RISK})::INT AS n_high_risk,
      md5(coalesce(string_agg(CASE WHEN {_RISK} THEN pos::VARCHAR END, ',' ORDER BY pos), '')) AS positions
    FROM scores GROUP BY seq_id""",
)
def residue_summary(spark, sf_dir):
    summary = ensemble.residue_summary(_letter_scores(spark, sf_dir), threshold=0.55)
    return summary.select(
        "seq_id",
        *[v.r6(F.col(c)).alias(c) for c in ("mean", "max", "min")],
        F.size("high_risk_positions").alias("n_high_risk"),
        F.md5(F.array_join("high_risk_positions", ",")).alias("positions"),
    )


@query(
    "top_high_risk",
    f"""WITH {_LETTER_RESIDUES}, risky AS (
      SELECT seq_id, pos, {_RISK} AS hit, count(*) FILTER ({_RISK}) OVER (PARTITION BY seq_id ORDER BY pos) AS nth FROM scores)
    SELECT seq_id, coalesce(string_agg(CASE WHEN hit AND nth <= 10 THEN pos::VARCHAR END, ',' ORDER BY pos), '') AS first_positions,
      count(*) FILTER (hit)::INT AS n_high_risk FROM risky GROUP BY seq_id""",
)
def top_high_risk(spark, sf_dir):
    summary = ensemble.residue_summary(_letter_scores(spark, sf_dir), threshold=0.55)
    top = ensemble.top_high_risk(summary)
    return top.select("seq_id", F.array_join("first_positions", ",").alias("first_positions"), "n_high_risk")


@query(
    "prediction_report",
    s.FOLD_SCORES
    + f""", res AS (SELECT seq_id, max(pos) + 1 AS length, avg({s.ENSEMBLE_RESIDUE}) AS mean, max({s.ENSEMBLE_RESIDUE}) AS max,
        min({s.ENSEMBLE_RESIDUE}) AS min, count(*) FILTER ({s.ENSEMBLE_RESIDUE} > 0.5)::INT AS n_high_risk FROM probs GROUP BY seq_id)
    SELECT seq_id, name, length::INT AS length, """
    + ", ".join(f"{v.sql_r6(f's{f}')} AS fold{f}_seq_score" for f in range(1, 6))
    + f""", {v.sql_r6(s.ENSEMBLE)} AS ensemble_score, {v.sql_r6('mean')} AS mean, {v.sql_r6('max')} AS max,
      {v.sql_r6('min')} AS min, n_high_risk FROM seq_scores JOIN res USING (seq_id)""",
)
def prediction_report(spark, sf_dir):
    report = ensemble.prediction_report(_scored(spark, sf_dir), v.FOLDS)
    numbers = [*[f"{f}_seq_score" for f in v.FOLDS], "ensemble_score", "mean", "max", "min"]
    return report.select("seq_id", "name", "length", *[v.r6(F.col(c)).alias(c) for c in numbers], "n_high_risk")


@query(
    "residue_profile_long",
    s.FOLD_SCORES
    + ", long AS ("
    + " UNION ALL ".join(
        [f"SELECT seq_id, 'fold{f}' AS series, pos, p{f} AS score FROM probs" for f in range(1, 6)]
        + [f"SELECT seq_id, 'ensemble', pos, {s.ENSEMBLE_RESIDUE} FROM probs"]
    )
    + f""") SELECT seq_id, series, count(*) AS n, (max(pos) + 1)::INT AS last_position,
      count(*) FILTER (aa = 'L') AS n_leucine, {v.sql_r6('avg(score)')} AS score,
      {v.sql_r6("avg(CASE WHEN aa = 'L' THEN score * ((pos + 1) / 1000.0::DOUBLE) ELSE 0 END)")} AS leucine_placed
    FROM long JOIN residues USING (seq_id, pos) GROUP BY seq_id, series""",
)
def residue_profile_long(spark, sf_dir):
    profile = ensemble.residue_profile_long(_scored(spark, sf_dir, True), v.FOLDS)
    leucine = F.col("aa") == "L"
    placed = F.when(leucine, F.col("score") * (F.col("position") / F.lit(1000.0))).otherwise(0.0)
    return profile.groupBy("seq_id", "series").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("position").alias("last_position"),
        F.count_if(leucine).alias("n_leucine"),
        v.r6(F.avg("score")).alias("score"),
        v.r6(F.avg(placed)).alias("leucine_placed"),
    )


@query(
    "compose_scoring",
    s.FOLD_SCORES
    + f""", res AS (SELECT seq_id, avg({s.ENSEMBLE_RESIDUE}) AS mean, max({s.ENSEMBLE_RESIDUE}) AS max FROM probs GROUP BY seq_id)
    SELECT seq_id, {v.sql_r6(s.ENSEMBLE)} AS ensemble_score, {v.sql_r6('mean')} AS mean, {v.sql_r6('max')} AS max
    FROM seq_scores JOIN res USING (seq_id)""",
)
def compose_scoring(spark, sf_dir):
    """Flagship: read, check, score with all folds, average, summarise."""
    return _scored(spark, sf_dir).select(
        "seq_id",
        v.r6(F.col("ensemble_score")).alias("ensemble_score"),
        v.r6(F.col("summary.mean")).alias("mean"),
        v.r6(F.col("summary.max")).alias("max"),
    )


@query(
    "residue_evaluation",
    s.FOLD_SCORES
    + f""", marked AS (
      SELECT {v.sql_split('seq_id')} AS data_split, (aa IN ('V','I','L','F','Y','W','M'))::INT AS y,
        ({s.ENSEMBLE_RESIDUE} >= 0.5::DOUBLE)::INT AS y_pred
      FROM probs JOIN (
        SELECT seq_id, unnest(range(length(sequence))) AS pos, unnest(string_split(sequence, '')) AS aa
        FROM seqs WHERE length(sequence) > 0) USING (seq_id, pos))
    SELECT data_split, sum((y = 1 AND y_pred = 1)::INT)::BIGINT AS tp, sum((y = 0 AND y_pred = 1)::INT)::BIGINT AS fp,
      sum((y = 0 AND y_pred = 0)::INT)::BIGINT AS tn, sum((y = 1 AND y_pred = 0)::INT)::BIGINT AS fn, count(*) AS total
    FROM marked GROUP BY data_split""",
)
def residue_evaluation(spark, sf_dir):
    """Residue labels beside residue scores, counted per split."""
    digits = F.split(v.residue_labels(F.col("sequence")), "")
    both = F.arrays_zip(digits.alias("y"), F.col("ensemble_residues").alias("score"))
    rows = _scored(spark, sf_dir).where(F.size("ensemble_residues") > 0).select(
        v.split_of(F.col("seq_id")).alias("data_split"), F.explode(both).alias("r")
    )
    table = rows.select(
        "data_split", F.col("r.y").cast("int").alias("y"), (F.col("r.score") >= 0.5).cast("int").alias("y_pred")
    )
    return confusion_counts(table, ["data_split"]).drop("tp+tn")


@query(
    "argmax_first",
    f"""WITH {v.SEQS}, ranked AS (SELECT "group", length(sequence)::INT AS len, seq_id,
      row_number() OVER (PARTITION BY "group" ORDER BY length(sequence) DESC, seq_id) AS rn FROM seqs)
    SELECT "group", seq_id, len FROM ranked WHERE rn = 1""",
)
def longest_first(spark, sf_dir):
    df = v.sequences(spark, sf_dir).withColumn("len", F.length("sequence"))
    return argmax_first(df, ["group"], "seq_id", "len")


# -- reduction, linear and regression models -----------------------------------


def _train_vectors(spark, sf_dir):
    return v.vectors(spark, sf_dir).where(F.col("data_split") == "train")


@query("fit_pca")
def fit_pca_report(spark, sf_dir):
    found = fit_pca(_train_vectors(spark, sf_dir), "embedding")
    rows = [(i, share, i < found.n_components) for i, share in enumerate(found.explained)]
    return spark.createDataFrame(rows, "component int, explained double, kept boolean")


@query(
    "pca_total_variance",
    f"""WITH {v.VECTORS}, train AS (SELECT * FROM vectors WHERE data_split = 'train'),
    dims AS (SELECT unnest(range(64)) AS i),
    per_dim AS (SELECT i, var_samp(embedding[i + 1]) AS var FROM train, dims GROUP BY i)
    SELECT (SELECT count(*) FROM train) AS n_rows, 64 AS components, {v.sql_r6("sum(var)")} AS total_variance,
      1 AS shares_hold, 1 AS uncorrelated FROM per_dim""",
)
def pca_total_variance(spark, sf_dir):
    """All components carry the whole variance, each its share, and no two are correlated."""
    train = _train_vectors(spark, sf_dir)
    found = fit_pca(train, "embedding", fraction=2.0)
    spread = apply_pca(train, "embedding", found)
    z = [F.col("components")[i] for i in range(64)]
    row = spread.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array(*[F.var_samp(x) for x in z]).alias("var"),
        F.max(F.lit(0)).alias("zero"),
        F.array(*[F.abs(F.covar_samp(a, b)) for a, b in zip(z, z[1:])]).alias("cov"),
    )
    total = arrays.array_sum(F.col("var"))
    shares = F.lit([float(x) for x in found.explained])
    off = F.zip_with("var", shares, lambda x, share: F.abs(x - share * total))
    return row.select(
        "n_rows",
        F.size("var").alias("components"),
        v.r6(total).alias("total_variance"),
        (F.array_max(off) < 1e-6).cast("int").alias("shares_hold"),
        (F.array_max("cov") < 1e-6).cast("int").alias("uncorrelated"),
    )


@query(
    "pca_residuals",
    f"""WITH {v.VECTORS} SELECT unnest(range(64))::INT AS component, 1 AS is_eigenvector, 1 AS in_order,
      (SELECT count(*) FROM vectors WHERE data_split = 'train') AS n_rows""",
)
def pca_residuals(spark, sf_dir):
    """Covariance times each component is that component times its variance."""
    train = _train_vectors(spark, sf_dir)
    found = fit_pca(train, "embedding", fraction=2.0)
    spread = apply_pca(train, "embedding", found).select("components", F.posexplode("embedding").alias("i", "x"))
    pairs = spread.select("i", "x", F.posexplode("components").alias("component", "z"))
    weights = spark.createDataFrame(list(enumerate(found.weights.tolist())), "i int, weights array<double>")
    cells = (
        pairs.groupBy("i", "component")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.covar_samp("x", "z").alias("cov"))
        .join(weights, "i")
        .select("n_rows", "component", "cov", F.col("weights")[F.col("component")].alias("weights"))
    )
    variance = cells.groupBy("component").agg(F.sum(F.col("cov") * F.col("weights")).alias("variance"))
    before = Window.orderBy("component")
    variance = variance.withColumn("previous", F.lag("variance").over(before))
    gap = F.max(F.abs(F.col("cov") - F.col("variance") * F.col("weights")))
    return cells.join(variance, "component").groupBy("component").agg(
        (gap < 1e-9).cast("int").alias("is_eigenvector"),
        F.max((F.coalesce("previous", "variance") >= F.col("variance") - 1e-12).cast("int")).alias("in_order"),
        F.max("n_rows").alias("n_rows"),
    )


@query(
    "apply_pca_norms",
    f"""WITH {v.VECTORS} SELECT seq_id, data_split, {v.sql_r6("list_dot_product(embedding, embedding)")} AS squares FROM vectors""",
)
def apply_pca_norms(spark, sf_dir):
    """All components together only turn a vector: its length stays, whatever their signs."""
    found = fit_pca(_train_vectors(spark, sf_dir), "embedding", fraction=2.0)
    projected = apply_pca(v.vectors(spark, sf_dir), "embedding", found)
    squares = F.aggregate("components", F.lit(0.0), lambda acc, x: acc + x * x)
    return projected.select("seq_id", "data_split", v.r6(squares).alias("squares"))


@query("apply_pca")
def apply_pca_rows(spark, sf_dir):
    found = fit_pca(_train_vectors(spark, sf_dir), "embedding")
    projected = apply_pca(v.vectors(spark, sf_dir), "embedding", found)
    return projected.select("seq_id", "data_split", F.posexplode("components").alias("component", "value"))


@query("pca_scatter_points")
def pca_points(spark, sf_dir):
    found = fit_pca(_train_vectors(spark, sf_dir), "embedding")
    return pca_scatter_points(v.vectors(spark, sf_dir), "embedding", found, ["seq_id", "label", "data_split"])


def _labeled_vectors(spark, sf_dir):
    return v.vectors(spark, sf_dir).withColumns(
        {"features": F.col("embedding").cast("array<double>"), "y": (F.col("label") < 5).cast("double")}
    )


@query("logreg_grid_cv")
def logreg_grid_cv(spark, sf_dir):
    """The whole default grid: five strengths, two penalties, five folds, and the refit."""
    train = _labeled_vectors(spark, sf_dir).where(F.col("data_split") == "train")
    return linear.logreg_grid_cv(train).to_table(spark)


@query(
    "logreg_grid_optimality",
    f"""WITH {v.VECTORS}, train AS (SELECT seq_id, (label < 5)::DOUBLE AS y FROM vectors WHERE data_split = 'train' AND label IS NOT NULL),
    hashed AS (SELECT *, ('0x' || substr(md5('42|' || seq_id::VARCHAR), 1, 15))::BIGINT AS h FROM train),
    folds AS (SELECT y, ((row_number() OVER (PARTITION BY y ORDER BY h, seq_id) - 1) % 5)::INT AS fold FROM hashed)
    SELECT fold, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS positive, 10::BIGINT AS fits, 10::BIGINT AS at_optimum
    FROM folds GROUP BY fold""",
)
def logreg_grid_optimality(spark, sf_dir):
    """Rows and positives of each fold, as the fits see them, and how many fits that leave
    it out meet their optimality conditions to 1e-6."""
    train = _labeled_vectors(spark, sf_dir).where(F.col("data_split") == "train")
    result = linear.logreg_grid_cv(train)
    rows = []
    for fold in range(linear.DEFAULT_SPLITS):
        own = [(t, m) for t, m in result.fits if t.fold == fold]
        everything = next(t.weight for t, _ in result.fits if t.fold is None)
        rows.append((fold, everything - own[0][0].weight, result.positives[fold], len(own), sum(m.kkt < 1e-6 for _, m in own)))
    return spark.createDataFrame(rows, "fold int, n double, positive double, fits long, at_optimum long")


_COEFFICIENTS = [v.weight(1, 1, 0, j, 0) for j in range(64)]


@query(
    "logreg_score",
    f"WITH {v.VECTORS}, z AS (SELECT seq_id, "
    + " + ".join(f"embedding[{j + 1}] * ({w!r}::DOUBLE)" for j, w in enumerate(_COEFFICIENTS))
    + f""" + 0.125::DOUBLE AS z FROM vectors)
    SELECT seq_id, {v.sql_r6('1.0::DOUBLE / (1.0::DOUBLE + exp(-z))')} AS y_pred_prob, (z > 0)::INT AS y_pred FROM z""",
)
def logreg_score(spark, sf_dir):
    model = linear.LinearModel(_COEFFICIENTS, 0.125)
    scored = linear.logreg_score(_labeled_vectors(spark, sf_dir), model)
    return scored.select("seq_id", v.r6(F.col("y_pred_prob")).alias("y_pred_prob"), "y_pred")


@query("persist_given_stages", SQL["logreg_score"])
def persist_given_stages(spark, sf_dir):
    """A composed model with given weights, saved, loaded and applied."""
    config = PipelineConfig(embedder="Precomputed", predictor="LogisticRegression")
    nothing = {"add": [], "standard": [], "dimred": []}
    state = linear.LinearModel(_COEFFICIENTS, 0.125)
    given = FittedPipeline(config, nothing, {}, {}, None, None, scalers.Scaler("none", {}, {}), None, state)
    path = scratch_path(spark, "given")
    save_pipeline(spark, given, path)
    scored = load_pipeline(spark, path).apply(v.vectors(spark, sf_dir))
    return scored.select("seq_id", v.r6(F.col("y_pred_prob")).alias("y_pred_prob"), "y_pred")


_MLP_HIDDEN = 4


def _mlp_model():
    return gradient.MlpModel(
        np.array([[v.weight(1, 1, 0, j, k) for k in range(_MLP_HIDDEN)] for j in range(64)]),
        np.array([v.weight(1, 1, 5, 0, k) for k in range(_MLP_HIDDEN)]),
        np.array([v.weight(1, 2, 0, j, 0) for j in range(_MLP_HIDDEN)]),
        v.weight(1, 2, 5, 0, 0),
    )


def _mlp_sql() -> str:
    hidden = []
    for k in range(_MLP_HIDDEN):
        total = " + ".join(f"embedding[{j + 1}] * ({v.weight(1, 1, 0, j, k)!r}::DOUBLE)" for j in range(64))
        hidden.append(f"tanh({total} + ({v.weight(1, 1, 5, 0, k)!r}::DOUBLE)) * ({v.weight(1, 2, 0, k, 0)!r}::DOUBLE)")
    return " + ".join(hidden) + f" + ({v.weight(1, 2, 5, 0, 0)!r}::DOUBLE)"


@query(
    "mlp_regression_score",
    f"WITH {v.VECTORS} SELECT seq_id, {v.sql_r6(_mlp_sql())} AS y_pred FROM vectors",
)
def mlp_regression_score(spark, sf_dir):
    scored = gradient.mlp_regression_score(_labeled_vectors(spark, sf_dir), _mlp_model())
    return scored.select("seq_id", v.r6(F.col("y_pred")).alias("y_pred"))


def _history(spark, fit):
    return spark.createDataFrame(fit.history, "epoch int, train_loss double, val_loss double")


@query("fit_attention")
def fit_attention(spark, sf_dir):
    """Loss per epoch of one fold trained on the labeled documents until it stops by itself."""
    df = v.sequences(spark, sf_dir, labels=True)
    _, fit = gradient.fit_attention(df, channels=4, optimizer="adam", rate=0.1, patience=2)
    return _history(spark, fit)


@query("fit_attention_batch_norm")
def fit_attention_batch_norm(spark, sf_dir):
    """The same with a hidden layer, batch norm and dropout."""
    _, fit = gradient.fit_attention(
        v.sequences(spark, sf_dir, labels=True), channels=4, head="mlp", optimizer="adam", rate=0.05,
        dropout=0.25, conv_dropout=0.25, patience=2,
    )
    return _history(spark, fit)


@query("fit_attention_first_step", s.first_step_sql())
def fit_attention_first_step(spark, sf_dir):
    """Losses and gradient norms of given parameters, batch norm over all training positions."""
    params = s.start_params()
    grads, stats = gradient.first_step(v.sequences(spark, sf_dir, labels=True), params)
    norm = lambda *parts: float(np.sqrt(sum((g * g).sum() for g in parts)))
    values = {
        "train_loss": stats[0] / stats[1],
        "val_loss": stats[2] / stats[3],
        "feature_norm": norm(*grads[:2]),
        "attention_norm": norm(*grads[2:4]),
        "head_norm": norm(*grads[4:8]),
        "batch_norm_norm": norm(*grads[8:10]),
        "temperature_norm": norm(grads[10]),
    }
    row = spark.createDataFrame([tuple(map(float, values.values()))], ", ".join(f"{k} double" for k in values))
    return row.select(*[v.r6(F.col(k)).alias(k) for k in values])


@query("fit_mlp_regression")
def fit_mlp_regression(spark, sf_dir):
    df = _labeled_vectors(spark, sf_dir).withColumn("y", F.col("label").cast("double"))
    _, fit = gradient.fit_mlp_regression(df, hidden=16, rate=0.05, patience=5)
    return _history(spark, fit)


def _fitted(spark, sf_dir):
    df = _labeled_vectors(spark, sf_dir).withColumn("value_bool", F.col("y")).drop("y", "features")
    config = PipelineConfig(
        embedder="Precomputed",
        dimred="PCADimReduction",
        predictor="LogisticRegression",
    )
    return df, compose_pipeline(df, config)


@query("compose_stages")
def compose_stages(spark, sf_dir):
    df, fitted = _fitted(spark, sf_dir)
    return fitted.apply(df).select("seq_id", "data_split", "y", "y_pred", "y_pred_prob")


@query("persist_stages")
def persist_stages(spark, sf_dir):
    """Predictions of a saved and reloaded model."""
    df, fitted = _fitted(spark, sf_dir)
    path = scratch_path(spark, "pipeline")
    save_pipeline(spark, fitted, path)
    return load_pipeline(spark, path).apply(df).select("seq_id", "data_split", "y", "y_pred", "y_pred_prob")

