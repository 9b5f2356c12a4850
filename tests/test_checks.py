import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.operators import checks, residues


@pytest.fixture
def seqs(spark):
    return spark.createDataFrame([(0, "ACD"), (1, "AXDZ"), (2, "")], "seq_id long, sequence string")


def test_quarantine_splits_rows(seqs):
    clean, rejected = checks.validate_alphabet(seqs)
    assert sorted(r["seq_id"] for r in clean.collect()) == [0, 2]
    row = rejected.first()
    assert (row["bad_letter"], row["bad_letter_pos"], row["n_bad"]) == ("X", 1, 2)


def test_fail_mode_names_the_letter(seqs):
    with pytest.raises(PySparkException, match="contains X"):
        checks.validate_alphabet(seqs, "fail").collect()


def test_length_guard_raises(seqs):
    with pytest.raises(PySparkException, match="longer than 3"):
        checks.max_length_guard(seqs, 3).collect()
    assert checks.max_length_guard(seqs, 4).count() == 3


def test_mask_and_copies(spark):
    df = spark.createDataFrame([("A#C",)], "s string")
    row = df.select(
        checks.mask_placeholder(F.col("s")).alias("m"),
        checks.tandem_copies(F.col("s"), 1).alias("one"),
        checks.tandem_copies(F.col("s"), 2).alias("two"),
    ).first()
    assert row["m"] == "A <mask> C"
    assert row["one"] == "A#C" and row["two"] == "A#C" + "G" * 25 + "A#C"
    with pytest.raises(ValueError):
        checks.mask_placeholder(F.col("s"), "A")
    with pytest.raises(ValueError):
        checks.tandem_copies(F.col("s"), 2, "SS")


def test_training_table_contract(spark):
    df = spark.createDataFrame([("A", 2.0, "train"), ("", 1.0, "dev")], "sequence string, value_bool double, data_split string")
    rows = {r["rule"]: r["n_rows"] for r in checks.check_training_table(
        df, "classification_binary", {"train": 0.7, "val": 0.2, "test": 0.1}, "data_split").collect()}
    assert rows["label_outside_0_1"] == 1 and rows["split_unknown"] == 1 and rows["sequence_missing"] == 1
    with pytest.raises(ValueError, match="sum to 1"):
        checks.check_training_table(df, "classification_binary", {"train": 0.7, "val": 0.2, "test": 0.2})
    with pytest.raises(ValueError, match="not found"):
        checks.check_training_table(df, "regression", {"train": 0.8, "val": 0.0, "test": 0.2})


def test_feature_columns(spark):
    df = spark.createDataFrame([("x", 1, 2.0, "t")], "data_b string, data_a int, other double, data_split string")
    assert checks.select_feature_columns(df, True)["add"] == ["data_a", "data_b"]
    assert checks.select_feature_columns(df, False)["add"] == []
    assert checks.select_feature_columns(df, ["other"], True)["standardize"] == ["other"]
    with pytest.raises(ValueError):
        checks.select_feature_columns(df, ["none"])
    assert checks.feature_channels(df, ["data_a", "data_b"]) == {"data_a": "real", "data_b": "categorical"}
    with pytest.raises(ValueError):
        checks.feature_channels(df.withColumn("data_c", F.array(F.lit(1))), ["data_c"])


def test_residue_labels_must_fit(spark):
    df = spark.createDataFrame([(0, "ACD", "010")], "seq_id long, sequence string, labels string")
    rows = residues.residue_explode(df, "labels").collect()
    assert [(r["pos"], r["aa"], r["res_value_bool"]) for r in rows] == [(0, "A", 0), (1, "C", 1), (2, "D", 0)]
    with pytest.raises(PySparkException, match="labels do not fit"):
        residues.residue_explode(df.withColumn("labels", F.lit("01")), "labels").collect()


def test_missing_sequence_has_no_residues(spark):
    rows = [(0, "AC", "01"), (1, None, None), (2, "", "")]
    df = spark.createDataFrame(rows, "seq_id long, sequence string, labels string")
    assert [r["seq_id"] for r in residues.residue_explode(df, "labels").collect()] == [0, 0]
    for sequence, labels in (("AC", None), (None, "01")):
        unfit = spark.createDataFrame([(3, sequence, labels)], df.schema)
        with pytest.raises(PySparkException, match="labels do not fit"):
            residues.residue_explode(unfit, "labels").collect()


@pytest.mark.parametrize("labels", [None, "labels"])
def test_every_letter_has_a_row(spark, monkeypatch, labels):
    rows = [(0, "ACD", "010"), (1, None, None), (2, "", ""), (2, "K", "1")]
    df = spark.createDataFrame(rows, "seq_id long, sequence string, labels string")
    found = residues.residue_explode(df, labels).collect()
    assert sorted((r["seq_id"], r["pos"], r["aa"], r["length"]) for r in found) == [
        (0, 0, "A", 3), (0, 1, "C", 3), (0, 2, "D", 3), (2, 0, "K", 1)
    ]
    all_letters = residues.letters
    monkeypatch.setattr(residues, "letters", lambda s: F.slice(all_letters(s), 1, 2))
    with pytest.raises(PySparkException, match="rows do not fit sequence 0"):
        residues.residue_explode(df, labels).collect()


def test_pooled_letters_equal_pooled_array(spark):
    df = spark.createDataFrame([("ACDWY",), ("K",)], "sequence string")
    for kind, width in (("onehot", 20), ("zscale", 5)):
        row = df.select(
            residues.mean_pool_letters(F.col("sequence"), kind).alias("a"),
            residues.mean_pool(residues.encoded_array(F.col("sequence"), kind), width).alias("b"),
        ).collect()
        for r in row:
            assert r["a"] == pytest.approx(r["b"])


def test_quarantine_loses_no_row(spark):
    df = spark.createDataFrame([(1, "ACD"), (2, None), (3, "AXC"), (4, "")], "seq_id long, sequence string")
    clean, rejected = checks.validate_alphabet(df)
    reasons = {r["seq_id"]: r["reason"] for r in rejected.collect()}
    assert reasons == {2: "missing", 3: "letter"}
    assert sorted(r["seq_id"] for r in clean.collect()) == [1, 4]
