import json
from pathlib import Path

import numpy as np
import pytest

from seqloom.plans.inference import run_inference
from seqloom.catalog import views as v
from seqloom.sources import readers


def test_csv_names_rows_in_file_order(spark, tmp_path):
    for part in range(3):
        lines = "\n".join(f"{'ACDE'[part]}{'K' * i}" for i in range(4))
        (tmp_path / f"part{part}.csv").write_text("sequence\n" + lines + "\n")
    rows = readers.read_sequences_csv(spark, str(tmp_path)).collect()
    assert sorted(r["name"] for r in rows) == sorted(f"seq_{i}" for i in range(12))
    by_name = {r["name"]: r["sequence"] for r in rows}
    assert by_name["seq_0"] == "A" and by_name["seq_4"] == "C" and by_name["seq_11"] == "DKKK"


def test_csv_keeps_names_drops_index_and_needs_sequence(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(",sequence,name\n0,ACD, one\n1,KLM, two\n")
    df = readers.read_sequences_csv(spark, str(path), has_index=True)
    assert df.columns == ["sequence", "name"]
    assert [r["name"] for r in df.collect()] == [" one", " two"]
    bad = tmp_path / "b.csv"
    bad.write_text("x\n1\n")
    with pytest.raises(ValueError):
        readers.read_sequences_csv(spark, str(bad))


def test_csv_is_preferred_to_parquet(spark, tmp_path):
    stem = str(tmp_path / "t")
    spark.createDataFrame([("PARQUET",)], "sequence string").write.parquet(stem + ".parquet.gzip")
    assert readers.read_sequences_parquet(spark, stem).first()["sequence"] == "PARQUET"
    (tmp_path / "t.csv").write_text(",sequence\n0,CSV\n")
    assert readers.read_sequences_parquet(spark, stem).first()["sequence"] == "CSV"
    with pytest.raises(FileNotFoundError):
        readers.read_sequences_parquet(spark, str(tmp_path / "none"))


def test_fasta_wrapped_blank_and_crlf(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_bytes(b">sp|P1 first protein\nACDE\nFGHI\n\n>two\r\nKL\r\nMN\r\n>empty\n>last\nWY")
    rows = {r["name"]: r["sequence"] for r in readers.read_fasta(spark, str(path)).collect()}
    assert rows == {"sp|P1": "ACDEFGHI", "two": "KLMN", "empty": "", "last": "WY"}


def test_fasta_splits_across_partitions(spark, tmp_path):
    path = tmp_path / "big.fasta"
    path.write_text("".join(f">s{i} x\n{'ACDEFGHIKL' * 30}\n{'MNPQ' * 5}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = readers.read_fasta(spark, str(path))
        assert df.rdd.getNumPartitions() > 1
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2000 and {len(r["sequence"]) for r in rows} == {320}


def test_model_registry(spark, tmp_path):
    for model, cutoffs in {"A": (0.42, 0.35000000000000003), "B": (0.31,)}.items():
        for i, cutoff in enumerate(cutoffs, 1):
            folder = tmp_path / model / f"fold{i}"
            folder.mkdir(parents=True)
            (folder / "model.yaml").write_text(
                "dataset:\n  data_split_column: data_split_fold%d\n"
                "embedder:\n  class_name: ESM\n  hparams: null\n"
                "predictor:\n  class_name: LightAttention\n  hparams:\n    kernel_size: 5\n"
                "    conv1d_output_dim: -1\n    post_attention: mlp\n    optimal_cutoff: %r\n"
                "    reduction_mode: 'max' # comment\n    penalty_weight: 0.0\n" % (i, cutoff)
            )
    registry = readers.scan_model_registry(spark, str(tmp_path))
    rows = {(r["model"], r["fold"]): r for r in registry.collect()}
    assert set(rows) == {("A", "fold1"), ("A", "fold2"), ("B", "fold1")}
    second = rows["A", "fold2"]
    assert second["class_name"] == "LightAttention" and second["kernel_size"] == 5
    assert second["optimal_cutoff"] == 0.35000000000000003 and second["conv1d_output_dim"] == -1
    assert second["reduction_mode"] == "max" and second["data_split_column"] == "data_split_fold2"
    assert {r["model"]: r["n_folds"] for r in readers.fold_counts(registry).collect()} == {"A": 2, "B": 1}


def test_inference_files(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, "dup", "ACDEFG"), (1, "dup", "K"), (2, "bad", "AXB")], "seq_id long, name string, sequence string"
    )
    models = v.fold_models(folds=2)
    with pytest.raises(Exception, match="sequence 2 contains X"):
        run_inference(df, models, "m", str(tmp_path / "failing"))
    paths = run_inference(df, models, "m", str(tmp_path / "out"), on_invalid="quarantine")
    rejected = spark.read.option("header", True).csv(paths["rejected"]).collect()
    assert [(r["sequence"], r["bad_letter"]) for r in rejected] == [("AXB", "X")]
    table = spark.read.option("header", True).csv(paths["sequences"])
    assert table.columns == ["name", "sequence", "m_fold1_seq_score", "m_fold2_seq_score", "m_ensemble_seq_score"]
    assert table.count() == 2  # same names are kept apart
    lines = [json.loads(r[0]) for r in spark.read.text(paths["residues"]).collect()]
    one = next(x for x in lines if x["sequence"] == "K")
    assert one["length"] == 1 and len(one["fold_scores"]["fold1"]) == 1
    assert one["summary"]["mean"] == pytest.approx(one["ensemble"][0])
    with pytest.raises(Exception):
        run_inference(df, models, "m", str(tmp_path / "out"))


def test_a_single_sink_writes_what_both_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "ACD"), (2, "b", "KKWY")], "seq_id long, name string, sequence string")
    models = v.fold_models(folds=2)
    both = run_inference(df, models, "m", str(tmp_path / "both"))
    for sink, read in (("sequences", spark.read.option("header", True).csv), ("residues", spark.read.json)):
        only = run_inference(df, models, "m", str(tmp_path / sink), sinks=(sink,))
        assert set(only) == {sink}
        assert sorted(read(only[sink]).collect()) == sorted(read(both[sink]).collect())
    for wrong in ((), ("sequences", "figures")):
        with pytest.raises(ValueError, match="sinks"):
            run_inference(df, models, "m", str(tmp_path / "wrong"), sinks=wrong)


def test_residue_file_is_compressed(spark, tmp_path):
    letters = np.random.default_rng(1).choice(list("ACDEFGHIKL"), 4000)
    df = spark.createDataFrame([(1, "a", "".join(letters)), (2, "b", "K")], "seq_id long, name string, sequence string")
    path = run_inference(df, v.fold_models(folds=2), "m", str(tmp_path / "out"), sinks=("residues",))["residues"]
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert sorted(json.loads(x)["length"] for x in lines) == [1, 4000]
    assert all(len(s) == x["length"] for x in map(json.loads, lines) for s in (x["ensemble"], *x["fold_scores"].values()))
    written = sum(p.stat().st_size for p in Path(path).glob("part-*"))
    assert written < sum(map(len, lines)) / 3
