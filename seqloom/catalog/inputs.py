"""Sources, sinks, checks and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import ALPHABET, LINKER
from ..operators import checks, splits, tables
from ..operators.metrics import optimal_cutoff
from ..plans.evaluation import evaluate_predictions
from ..plans.inference import run_inference
from ..session import scratch_path
from ..sources import readers
from . import views as v
from .registry import query
from .scoring_sql import CLASSIFICATION_SQL, FOLD_SCORES, folds_wide_sql

# -- sources -------------------------------------------------------------------


@query(
    "read_sequences_csv",
    f"WITH {v.SEQS} SELECT name, length(sequence)::INT AS len, md5(sequence) AS digest FROM seqs",
)
def read_sequences_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    v.sequences(spark, sf_dir).select("name", "sequence").write.option("header", True).csv(path)
    df = readers.read_sequences_csv(spark, path)
    return df.select("name", F.length(F.coalesce("sequence", F.lit(""))).alias("len"), F.md5(F.coalesce("sequence", F.lit(""))).alias("digest"))


@query(
    "read_unnamed_csv",
    f"""WITH {v.SEQS} SELECT count(*) AS n_rows, count(DISTINCT seq_id)::BIGINT AS n_names,
      sum(length(sequence))::BIGINT AS n_letters, 1 AS consecutive, 0 AS has_index FROM seqs""",
)
def read_unnamed_csv(spark, sf_dir):
    """A CSV without names and with an index column: names are seq_0, seq_1, ..."""
    path = scratch_path(spark, "csv")
    rows = v.sequences(spark, sf_dir).select(F.col("seq_id").alias("_c0"), "sequence", "data_split")
    rows.write.option("header", True).csv(path)
    df = readers.read_sequences_csv(spark, path, has_index=True)
    number = F.regexp_extract("name", "^seq_([0-9]+)$", 1).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("name").alias("n_names"),
        F.sum(F.length(F.coalesce("sequence", F.lit("")))).alias("n_letters"),
        ((F.min(number) == 0) & (F.max(number) == F.count(F.lit(1)) - 1)).cast("int").alias("consecutive"),
        F.lit(int("_c0" in df.columns)).alias("has_index"),
    )


@query(
    "read_sequences_parquet",
    "SELECT lang, count(*) AS n_rows, sum(length(text))::BIGINT AS n_letters FROM documents GROUP BY lang",
)
def read_sequences_parquet(spark, sf_dir):
    df = readers.read_sequences_parquet(spark, f"{sf_dir}/documents")
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_letters")
    )


@query(
    "read_fasta",
    f"WITH {v.SEQS} SELECT name, length(sequence)::INT AS len, md5(sequence) AS digest FROM seqs",
)
def read_fasta(spark, sf_dir):
    path = scratch_path(spark, "fasta")
    wrapped = F.regexp_replace("sequence", "(.{60})", "$1\n")
    v.sequences(spark, sf_dir).select(
        F.concat(F.lit(">"), "name", F.lit(" "), "group", F.lit("\n"), wrapped)
    ).write.text(path)
    df = readers.read_fasta(spark, path)
    return df.select("name", F.length("sequence").alias("len"), F.md5("sequence").alias("digest"))


@query(
    "with_inference_defaults",
    f"""WITH {v.SEQS}
    SELECT seq_id, 1 AS value_bool, 'user_input' AS dataset, 'test' AS data_split,
           length(sequence)::INT AS len FROM seqs""",
)
def with_inference_defaults(spark, sf_dir):
    df = checks.with_inference_defaults(v.sequences(spark, sf_dir), overwrite_split=True)
    return df.select("seq_id", "value_bool", "dataset", "data_split", "len")


@query(
    "scan_model_registry",
    f"""WITH {v.SCORED}, folded AS (
      SELECT "group" AS model, 'fold' || (1 + event_id % 5) AS fold, y, y_pred_prob FROM scored),
    cut AS (SELECT i AS step, i * 0.01::DOUBLE AS c FROM range(101) t(i)),
    conf AS (
      SELECT model, fold, step, c,
        sum((y = 1 AND y_pred_prob > c)::INT)::DOUBLE AS tp, sum((y = 0 AND y_pred_prob > c)::INT)::DOUBLE AS fp,
        sum((y = 0 AND NOT y_pred_prob > c)::INT)::DOUBLE AS tn, sum((y = 1 AND NOT y_pred_prob > c)::INT)::DOUBLE AS fn
      FROM folded, cut GROUP BY ALL),
    scoredcut AS (
      SELECT *, round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0
        THEN (tp*tn - fp*fn) / (sqrt(tp+fp)*sqrt(tp+fn)*sqrt(tn+fp)*sqrt(tn+fn)) ELSE 0 END, 12) AS mcc FROM conf),
    best AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY mcc DESC, step) AS rn FROM scoredcut)
    SELECT model, fold, 'LightAttention' AS class_name, 5 AS kernel_size, 'weighted_mean_three' AS reduction_mode,
           c AS optimal_cutoff, 5 AS n_folds
    FROM best WHERE rn = 1""",
)
def scan_model_registry(spark, sf_dir):
    """Cutoffs found per group and fold are written as config files and scanned back."""
    folded = v.scored_events(spark, sf_dir).select(
        F.col("group").alias("model"),
        F.concat(F.lit("fold"), 1 + F.col("event_id") % 5).alias("fold"),
        "y",
        "y_pred_prob",
    )
    config = F.concat(
        F.lit(
            "embedder:\n  class_name: ZScale\npredictor:\n  class_name: LightAttention\n  hparams:\n"
            "    kernel_size: 5\n    post_attention: mlp\n    reduction_mode: weighted_mean_three\n    optimal_cutoff: "
        ),
        F.col("optimal_mcc_cutoff").cast("string"),
    )
    path = scratch_path(spark, "registry")
    optimal_cutoff(folded, ["model", "fold"]).select(
        "model", "fold", config.alias("value")
    ).write.partitionBy("model", "fold").text(path)
    registry = readers.scan_model_registry(
        spark, path, "*/*/part-*", r"model=([^/]+)/fold=([^/]+)/[^/]+$"
    )
    return registry.join(readers.fold_counts(registry), "model").select(
        "model", "fold", "class_name", "kernel_size", "reduction_mode", "optimal_cutoff", "n_folds"
    )


# -- sinks ---------------------------------------------------------------------


@query("write_sequence_scores", FOLD_SCORES + folds_wide_sql())
def write_sequence_scores(spark, sf_dir):
    path = scratch_path(spark, "scores")
    written = run_inference(v.sequences(spark, sf_dir), v.fold_models(), "model", path, sinks=("sequences",))
    columns = [f"model_{f}_seq_score" for f in v.FOLDS] + ["model_ensemble_seq_score"]
    df = spark.read.option("header", True).csv(written["sequences"])
    return df.select("name", *[v.r6(F.col(c).cast("double")).alias(c) for c in columns])


@query(
    "write_residue_scores",
    FOLD_SCORES
    + f"""SELECT name, max(pos) + 1 AS length, {", ".join(f"{v.sql_r6(f'sum(p{f})')} AS fold{f}_sum" for f in range(1, 6))},
      {v.sql_r6('sum((p1+p2+p3+p4+p5)/5.0)')} AS ensemble_sum, {v.sql_r6('avg((p1+p2+p3+p4+p5)/5.0)')} AS mean,
      sum(((p1+p2+p3+p4+p5)/5.0 > 0.5)::INT)::BIGINT AS n_high_risk
    FROM probs GROUP BY seq_id, name""",
)
def write_residue_scores(spark, sf_dir):
    path = scratch_path(spark, "residues")
    written = run_inference(v.sequences(spark, sf_dir), v.fold_models(), "model", path, sinks=("residues",))
    maps = ", ".join(f"{f} array<double>" for f in v.FOLDS)
    df = spark.read.schema(
        f"name string, length long, fold_scores struct<{maps}>, ensemble array<double>, "
        "summary struct<mean double, high_risk_positions array<int>>"
    ).json(written["residues"])

    def total(c):
        return v.r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))

    return df.select(
        "name",
        "length",
        *[total(f"fold_scores.{f}").alias(f"{f}_sum") for f in v.FOLDS],
        total("ensemble").alias("ensemble_sum"),
        v.r6(F.col("summary.mean")).alias("mean"),
        F.size("summary.high_risk_positions").cast("long").alias("n_high_risk"),
    )


@query(
    "write_eval_tables",
    CLASSIFICATION_SQL
    + f"""SELECT data_split, "group", tp::BIGINT AS tp, total::BIGINT AS total, {v.sql_r6('accuracy')} AS accuracy,
       {v.sql_r6('matthews_corr_coef')} AS matthews_corr_coef FROM metrics""",
)
def write_eval_tables(spark, sf_dir):
    scored = v.scored_events(spark, sf_dir)
    parts = {s: splits.split_view(scored, s) for s in splits.SPLITS}
    paths = evaluate_predictions(parts, scratch_path(spark, "eval"), group="group")
    stats = spark.read.option("header", True).csv(paths["stats"])
    groups = spark.read.option("header", True).csv(paths["group_stats"])
    both = stats.unionByName(groups)
    return both.select(
        "data_split",
        F.coalesce("group", F.lit("")).alias("group"),
        F.col("tp").cast("long").alias("tp"),
        F.col("total").cast("long").alias("total"),
        v.r6(F.col("accuracy").cast("double")).alias("accuracy"),
        v.r6(F.col("matthews_corr_coef").cast("double")).alias("matthews_corr_coef"),
    )


# -- checks --------------------------------------------------------------------

_RAW = f"""raw AS (SELECT doc_id AS seq_id, {v.SQL_LETTERS.format(text='text')} AS sequence FROM documents)"""


def _raw(spark, sf_dir):
    raw = v.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq_id"), v.letters_of(F.col("text")).alias("sequence")
    )
    return v.spread_rows(raw, v.shuffle_width(spark))


@query(
    "validate_alphabet",
    f"""WITH {_RAW}, bad AS (
      SELECT seq_id, sequence, regexp_extract(sequence, '[^{ALPHABET}]') AS bad_letter FROM raw)
    SELECT seq_id, CASE WHEN sequence IS NULL THEN 'missing' ELSE 'letter' END AS reason, bad_letter,
           (strpos(sequence, bad_letter) - 1)::INT AS bad_letter_pos,
           length(regexp_replace(sequence, '[{ALPHABET}]', '', 'g'))::INT AS n_bad
    FROM bad WHERE sequence IS NULL OR bad_letter <> ''""",
)
def validate_alphabet(spark, sf_dir):
    _, rejected = checks.validate_alphabet(_raw(spark, sf_dir))
    return rejected.select("seq_id", "reason", "bad_letter", "bad_letter_pos", "n_bad")


@query(
    "mask_placeholder",
    f"""WITH {_RAW}, marked AS (SELECT seq_id, regexp_replace(sequence, '[^{ALPHABET}]', '#', 'g') AS s FROM raw)
    SELECT seq_id, md5(replace(regexp_replace(regexp_replace(s, '(.)', '\\1 ', 'g'), ' $', ''), '#', '<mask>')) AS digest
    FROM marked""",
)
def mask_placeholder(spark, sf_dir):
    marked = F.regexp_replace("sequence", f"[^{ALPHABET}]", "#")
    return _raw(spark, sf_dir).select("seq_id", F.md5(checks.mask_placeholder(marked)).alias("digest"))


@query(
    "tandem_copies",
    f"""WITH {v.SEQS} SELECT seq_id, (3 * length(sequence) + 50)::INT AS len,
      md5(sequence || '{LINKER}' || sequence || '{LINKER}' || sequence) AS digest FROM seqs""",
)
def tandem_copies(spark, sf_dir):
    df = v.sequences(spark, sf_dir).withColumn("t", checks.tandem_copies(F.col("sequence"), 3))
    return df.select("seq_id", F.length("t").alias("len"), F.md5("t").alias("digest"))


@query(
    "central_copy_slice",
    f"""WITH {v.SEQS} SELECT seq_id, (length(sequence) + 25)::INT AS start, length(sequence)::INT AS len,
      md5(sequence) AS digest FROM seqs WHERE length(sequence) > 0""",
)
def central_copy_slice(spark, sf_dir):
    """Letters of the middle copy, cut out of the tandem letters by position."""
    df = v.sequences(spark, sf_dir).where(F.length("sequence") > 0)
    letters = F.split(checks.tandem_copies(F.col("sequence"), 3), "")
    part = checks.central_copy_slice(letters, F.length("sequence"), 3)
    return df.select(
        "seq_id",
        checks.central_copy_start(F.length("sequence"), 3).alias("start"),
        F.size(part).alias("len"),
        F.md5(F.array_join(part, "")).alias("digest"),
    )


@query(
    "max_length_guard",
    f"WITH {v.SEQS} SELECT seq_id, length(sequence)::INT AS len FROM seqs WHERE length(sequence) > 1000",
)
def max_length_guard(spark, sf_dir):
    return checks.too_long(v.sequences(spark, sf_dir)).select("seq_id", F.length("sequence").alias("len"))


@query(
    "check_training_table",
    f"""WITH {v.LABELED}
    SELECT 'sequence_missing' AS rule, count(*) FILTER (sequence = '') AS n_rows FROM labeled
    UNION ALL SELECT 'target_missing', count(*) FILTER (value_bool IS NULL) FROM labeled
    UNION ALL SELECT 'target_nan', 0 FROM labeled GROUP BY 1
    UNION ALL SELECT 'label_outside_0_1', count(*) FILTER (value_bool NOT IN (0, 1)) FROM labeled
    UNION ALL SELECT 'split_unknown', count(*) FILTER (data_split NOT IN ('train', 'val', 'test')) FROM labeled
    UNION ALL SELECT 'group_missing', count(*) FILTER ("group" IS NULL) FROM labeled""",
)
def check_training_table(spark, sf_dir):
    return checks.check_training_table(
        v.sequences(spark, sf_dir, labels=True),
        "classification_binary",
        {"train": 0.8, "val": 0.1, "test": 0.1},
        "data_split",
        "group",
    )


@query("select_target", f"WITH {v.LABELED} SELECT seq_id, value_bool AS y FROM labeled")
def select_target(spark, sf_dir):
    df = checks.select_target(v.sequences(spark, sf_dir, labels=True), "classification_binary")
    return df.select("seq_id", "y")


_FEATURED = f"""featured AS (
  SELECT event_id, event_type AS data_type, user_id AS data_user, value AS data_value,
         {v.sql_split('user_id')} AS data_split FROM events)"""


@query(
    "select_feature_columns",
    f"WITH {_FEATURED} SELECT event_id, data_type, data_user, data_value FROM featured",
)
def select_feature_columns(spark, sf_dir):
    df = v.featured_events(spark, sf_dir)
    return df.select("event_id", *checks.select_feature_columns(df, True)["add"])


@query(
    "typed_feature_channels",
    f"WITH {_FEATURED} SELECT event_id, data_type, data_user::DOUBLE AS data_user, data_value FROM featured",
)
def typed_feature_channels(spark, sf_dir):
    df = v.featured_events(spark, sf_dir)
    columns = checks.select_feature_columns(df, True)["add"]
    return checks.typed_feature_channels(df, columns).select("event_id", *columns)


@query(
    "describe_columns",
    f"""WITH {v.LABELED}
    SELECT 'seq_id' AS "column", count(seq_id) AS n_filled, NULL::INT AS min_size, NULL::INT AS max_size FROM labeled
    UNION ALL SELECT 'name', count(name), min(length(name))::INT, max(length(name))::INT FROM labeled
    UNION ALL SELECT 'group', count("group"), min(length("group"))::INT, max(length("group"))::INT FROM labeled
    UNION ALL SELECT 'data_split', count(data_split), min(length(data_split))::INT, max(length(data_split))::INT FROM labeled
    UNION ALL SELECT 'sequence', count(sequence), min(length(sequence))::INT, max(length(sequence))::INT FROM labeled
    UNION ALL SELECT 'value_bool', count(value_bool), NULL, NULL FROM labeled""",
)
def describe_columns(spark, sf_dir):
    return checks.describe_columns(v.sequences(spark, sf_dir, labels=True))


# -- splits --------------------------------------------------------------------

_HASHED = """hashed AS (
  SELECT *, ('0x' || substr(md5('42|' || seq_id::VARCHAR), 1, 15))::BIGINT AS h FROM seqs)"""


@query(
    "predefined_split",
    f"""WITH {v.SEQS} SELECT s.data_split, count(seqs.seq_id) AS n_rows
    FROM (VALUES ('train'), ('val'), ('test')) s(data_split) LEFT JOIN seqs ON s.data_split = seqs.data_split
    GROUP BY s.data_split""",
)
def predefined_split(spark, sf_dir):
    return splits.predefined_split(v.sequences(spark, sf_dir))


def _split_sql(train: float, val_share: float) -> str:
    return f"""WITH {v.SEQS}, {_HASHED}, ranked AS (
      SELECT seq_id, row_number() OVER (ORDER BY h, seq_id) - 1 AS r, count(*) OVER () AS n FROM hashed),
    sized AS (SELECT *, floor(n * {train!r}::DOUBLE + 1e-9) AS n_train FROM ranked)
    SELECT seq_id, CASE WHEN r < n_train THEN 'train'
      WHEN r < n_train + floor((n - n_train) * {val_share!r}::DOUBLE + 1e-9) THEN 'val' ELSE 'test' END AS data_split
    FROM sized"""


def _ids(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"))


@query("random_split_2way", _split_sql(0.8, 0.0))
def random_split_2way(spark, sf_dir):
    return splits.random_split_2way(_ids(spark, sf_dir), 0.8)


@query("random_split_3way", _split_sql(0.7, 0.2 / (0.2 + 0.1)))
def random_split_3way(spark, sf_dir):
    return splits.random_split_3way(_ids(spark, sf_dir), 0.7, 0.2, 0.1)


@query("split_view", f"""WITH {v.SEQS} SELECT seq_id, name, "group" FROM seqs WHERE data_split = 'val'""")
def split_view(spark, sf_dir):
    return splits.split_view(v.sequences(spark, sf_dir), "val").select("seq_id", "name", "group")


@query(
    "fold_columns_to_long",
    """SELECT doc_id AS seq_id, 'fold' || f AS fold,
      CASE WHEN doc_id % 6 = 0 THEN 'test' WHEN doc_id % 6 = f THEN 'val' ELSE 'train' END AS data_split
    FROM documents, (VALUES (1), (2), (3), (4), (5)) folds(f)""",
)
def fold_columns_to_long(spark, sf_dir):
    part = F.col("seq_id") % 6
    wide = _ids(spark, sf_dir).withColumns(
        {
            f"data_split_fold{f}": F.when(part == 0, "test").when(part == f, "val").otherwise("train")
            for f in range(1, 6)
        }
    )
    return splits.fold_columns_to_long(wide, ["seq_id"])


@query(
    "stratified_folds",
    f"""WITH {v.LABELED}, hashed AS (
      SELECT *, ('0x' || substr(md5('42|' || seq_id::VARCHAR), 1, 15))::BIGINT AS h FROM labeled
      WHERE value_bool IS NOT NULL)
    SELECT seq_id, value_bool,
      ((row_number() OVER (PARTITION BY value_bool ORDER BY h, seq_id) - 1) % 5)::INT AS fold FROM hashed""",
)
def stratified_folds(spark, sf_dir):
    labeled = v.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("seq_id"), F.col("quality").cast("double").alias("value_bool")
    )
    return splits.stratified_folds(labeled.where("value_bool IS NOT NULL"), "value_bool", 5)


@query(
    "sample_weights",
    """SELECT doc_id AS seq_id, CASE WHEN doc_id % 10 < 8 THEN n_chars / 1000.0::DOUBLE END AS weight FROM documents""",
)
def sample_weights(spark, sf_dir):
    df = v.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq_id"),
        v.split_of(F.col("doc_id")).alias("data_split"),
        (F.col("n_chars") / F.lit(1000.0)).alias("sample_weight"),
    )
    return splits.sample_weights(df).select("seq_id", "weight")


@query(
    "balanced_class_weight",
    f"""WITH c AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality),
    w AS (SELECT quality, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) AS cw FROM c)
    SELECT doc_id AS seq_id, {v.sql_r6('cw')} AS class_weight FROM labels LEFT JOIN w USING (quality)""",
)
def balanced_class_weight(spark, sf_dir):
    labels = v.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("seq_id"), F.col("quality").alias("value_bool")
    )
    return splits.balanced_class_weight(labels).select(
        "seq_id", v.r6(F.col("class_weight")).alias("class_weight")
    )


# -- set operations ------------------------------------------------------------


@query(
    "union_splits",
    f"""WITH {v.SCORED} SELECT event_id, y, y_pred, data_split FROM scored""",
)
def union_splits(spark, sf_dir):
    scored = v.scored_events(spark, sf_dir)
    parts = {s: splits.split_view(scored, s).drop("data_split") for s in splits.SPLITS}
    return tables.union_splits(parts).select("event_id", "y", "y_pred", "data_split")


@query(
    "distinct_sequences",
    f"WITH {v.SEQS} SELECT DISTINCT md5(sequence) AS digest, length(sequence)::INT AS len FROM seqs",
)
def distinct_sequences(spark, sf_dir):
    df = tables.distinct_sequences(v.sequences(spark, sf_dir))
    return df.select(F.md5("sequence").alias("digest"), F.length("sequence").alias("len"))


@query(
    "attach_labels",
    f"""WITH {v.SEQS} SELECT seq_id, quality, toxic FROM seqs LEFT JOIN labels ON seq_id = doc_id""",
)
def attach_labels(spark, sf_dir):
    labels = v.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "seq_id")
    return tables.attach_labels(_ids(spark, sf_dir), labels)

