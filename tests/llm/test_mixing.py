import numpy as np
import pytest
from llm_rows import SCHEMA, labels, no_docs, no_labels, odd_docs, odd_rows, prose, row, table  # noqa: F401

from seqloom.llm import mixing


def wanted_targets(sizes):
    """Reshare by weight until no target is above three times its source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total >= 3 * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    return target


def check(docs, got):
    sizes, taken, target = {}, {}, {}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
    want = wanted_targets(sizes)
    assert target == pytest.approx(want)
    assert all(r["source_size"] == sizes[source[r["doc_id"]]] for r in got)
    return sizes, taken, want


def test_targets_and_taken_words(spark):
    docs = table(spark, "documents", "0.01")
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes, taken, want = check(docs, got)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(25, 0.002 * want[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}


def test_capped_sources_and_a_hot_size(spark):
    rows = [row(i, "a b c d e f g", source="hot") for i in range(400)]
    rows += [row(1000 + i, prose(i, 5 + i), source=s) for i, s in enumerate(["", "z", None, "é", "\U0001f600", "￿"])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(docs).collect()
    sizes, taken, want = check(docs, got)
    assert abs(taken["hot"] - want["hot"]) <= 7
    assert any(want[s] == 3 * sizes[s] for s in sizes)


def test_newton_solves_the_dual(spark):
    classes = spark.createDataFrame([("a", 5, 10), ("a", 7, 3), ("b", 2, 4)], "source_key string, size long, n long")
    targets = spark.createDataFrame([("a", 71, 200.0), ("b", 8, 0.5)], "source_key string, source_size long, target double")
    rate = {r["source_key"]: r["rate"] for r in mixing.balanced_rates(classes, targets).collect()}
    assert rate["a"] * 71 == pytest.approx(200.0)
    assert rate["b"] * 8 == pytest.approx(0.5)


def test_rows_nobody_likes(odd_docs, odd_rows, no_docs):
    got = mixing.mix(odd_docs).toPandas()
    assert len(got) == len(odd_rows)
    assert got[got.doc_id == 1]["size"].tolist() == [0]
    assert got[got.doc_id == 5].taken.nunique() == 1
    out = mixing.mixed_documents(odd_docs)
    assert out.schema == odd_docs.schema
    copies = out.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    for d, n in got.groupby("doc_id").copies.sum().items():
        assert copies.get(d, 0) == n
    assert np.isfinite(got.target).all()
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i % 3])
def test_missing_and_repeated_ids_meet_the_target(spark, ids):
    """Documents without an id of their own still share the extra copies."""
    rows = [row(ids(i), prose(i, 12), source="a") for i in range(600)]
    rows += [row(ids(i), "the same seven words in each row", source="a") for i in range(400)]
    rows += [row(5000 + i, prose(9000 + i, 11), source="b") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = mixing.mix(docs).collect()
    want = wanted_targets({"a": 600 * 12 + 400 * 7, "b": 300 * 11})
    assert len(got) == len(rows)
    for source, own in (("a", [r for r in got if r.target == pytest.approx(want["a"])]), ("b", [r for r in got if r.target == pytest.approx(want["b"])])):
        assert abs(sum(r.taken for r in own) - want[source]) <= 12
        for size in {r.size for r in own}:
            copies = {r.copies for r in own if r.size == size}
            assert max(copies) - min(copies) <= 1
    kept = mixing.mixed_documents(docs)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.copies for r in got)


def test_runs_where_workers_cannot_import_the_package(tmp_path):
    """Another folder, no PYTHONPATH: the operator sends the package along."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
from seqloom.llm import mixing
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {str(tmp_path / "scratch")!r}).getOrCreate()
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
print("ROWS", mixing.mix(docs).count() == docs.count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240
    )
    assert "ROWS True" in done.stdout, done.stderr[-2000:]


def test_newton_steps_start_no_jobs_of_their_own(spark):
    """Each job leaves plans, broadcasts and threads in the driver for a while."""
    classes = spark.createDataFrame([("a", 5, 10), ("a", 7, 3), ("b", 2, 4), ("c", 0, 9)], "source_key string, size long, n long")
    targets = spark.createDataFrame(
        [("a", 71, 213.0), ("b", 8, 1e-9), ("c", 0, 0.0)], "source_key string, source_size long, target double"
    )
    context = spark.sparkContext
    context.setJobGroup("newton", "")
    rates = mixing.balanced_rates(classes, targets)
    jobs = context.statusTracker().getJobIdsForGroup("newton")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 5
    rate = {r["source_key"]: r["rate"] for r in rates.collect()}
    assert rate["a"] == pytest.approx(3.0, rel=1e-14) and rate["b"] * 8 == pytest.approx(1e-9, rel=1e-12) and rate["c"] == 0
