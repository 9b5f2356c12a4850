import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.catalog import views as v
from seqloom.functions.constants import POOL_MODES
from seqloom.operators import features, gradient, linear
from seqloom.operators.dimred import apply_pca, components_needed, fit_pca
from seqloom.plans.pipeline import (
    PipelineConfig,
    Stage,
    compose_pipeline,
    load_pipeline,
    register_stage,
    save_pipeline,
    stage,
)


@pytest.mark.parametrize("mode", POOL_MODES)
@pytest.mark.parametrize("head,outputs", [("linear", 1), ("mlp", 2), ("mlp_deep", 1)])
def test_attention_gradient_by_finite_differences(mode, head, outputs):
    rng = np.random.default_rng(11)
    lengths = np.array([1, 4, 7])
    x = rng.normal(size=(12, 3))
    y = np.array([1.0, 0.0, 1.0])
    params = gradient.init_attention(3, 2, 3, head, outputs, rng)
    params[-1] = np.array([0.8])

    def loss(flat):
        _, values, _ = gradient.attention_gradient(gradient.unpack(flat, params), x, lengths, y, mode, 0.3)
        return values.sum()

    grads, _, _ = gradient.attention_gradient(params, x, lengths, y, mode, 0.3)
    got, flat = gradient.pack(grads), gradient.pack(params)
    picked = np.unique(np.concatenate([np.arange(0, len(flat), max(1, len(flat) // 60)), [len(flat) - 1]]))
    for i in picked:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert got[i] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=2e-5, rel=1e-3)


def pieces_of(rng, sizes, dropout=0.0):
    """Training rows in pieces as tasks would see them, each with a validation row."""
    import pyarrow as pa

    out, number = [], 0
    for n in sizes:
        letters = ["".join(rng.choice(list("ACDEFGHIK"), rng.integers(1, 8))) for _ in range(n)]
        ids = np.arange(number, number + n)
        number += n
        y = pa.array((ids % 3 == 0).astype(float))
        held = pa.array(ids % 5 == 4)
        out.append(pa.RecordBatch.from_arrays([pa.array(letters), pa.array(ids), y, held], ["sequence", "number", "y", "held"]))
    return out


def sum_of(pieces):
    def sum_over(shared, give, size):
        total = np.zeros(size)
        for piece in pieces:
            total = total + give(shared, piece)
        return total

    return sum_over


@pytest.mark.parametrize("mode", ["max", "weighted_mean_three", "mean_single_conv"])
@pytest.mark.parametrize("head", ["mlp", "mlp_deep"])
@pytest.mark.parametrize("rate", [0.0, 0.3])
def test_batch_norm_gradient_over_several_pieces_by_finite_differences(mode, head, rate):
    """The moments join all pieces, so each row's loss depends on every other row."""
    rng = np.random.default_rng(3)
    pieces = pieces_of(rng, [4, 1, 6])
    params = gradient.init_attention(5, 2, 3, head, 1, rng)
    units = 32
    params = [*params[:-1], rng.uniform(0.5, 1.5, units), rng.normal(size=units) / 5, np.array([0.8])]
    how = gradient.Training("zscale", mode, 0.2, {0: 4.0, 2: 4.0}, rate, rate)
    running = (np.zeros(units), np.ones(units))

    def step(flat, at):
        return gradient.training_step(sum_of(at), gradient.unpack(flat, params), how, 3, running)

    flat = gradient.pack(params)
    got, stats, moments = step(flat, pieces)
    assert stats[1] + stats[3] == 11
    picked = np.unique(np.concatenate([np.arange(0, len(flat), max(1, len(flat) // 40)), np.arange(len(flat) - 65, len(flat), 7), [len(flat) - 1]]))
    for i in picked:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (step(up, pieces)[1][0] - step(down, pieces)[1][0]) / 2e-6
        assert got[i] == pytest.approx(slope, abs=5e-5, rel=2e-3)
    # Any cut of the rows into pieces gives the same step, dropout included.
    import pyarrow as pa

    whole = pa.Table.from_batches(pieces).combine_chunks().to_batches()
    again, stats_again, moments_again = step(flat, whole)
    assert np.allclose(got, again) and np.allclose(stats, stats_again)
    assert np.allclose(moments, moments_again)


def test_dropout_masks_follow_from_what_they_mask():
    from seqloom.functions.masks import Dropout

    rows, lengths = np.array([7, 8, 9]), np.array([500, 3, 400])
    whole = Dropout(0.25, 1, 2, rows, lengths).mask(1, 16)
    part = Dropout(0.25, 1, 2, rows[1:], lengths[1:]).mask(1, 16)
    assert (whole[500:] == part).all()
    assert set(np.unique(whole)) == {0.0, 1 / 0.75}
    assert abs((whole == 0).mean() - 0.25) < 0.02
    for other in (Dropout(0.25, 1, 3, rows, lengths).mask(1, 16), Dropout(0.25, 2, 2, rows, lengths).mask(1, 16), Dropout(0.25, 1, 2, rows, lengths).mask(2, 16)):
        assert 0.2 < (whole != other).mean() < 0.55
    assert Dropout(0.0, 1, 2, rows, lengths).mask(1, 16) is None


def test_batch_norm_and_dropout_learn_and_fold_into_the_scorer(spark, peptides):
    from seqloom.operators.attention import score_folds

    kwargs = dict(kernel=3, channels=3, head="mlp", optimizer="adam", rate=0.05, epochs=40, patience=5, dropout=0.1, conv_dropout=0.1)
    model, fit = gradient.fit_attention(peptides.repartition(5), **kwargs)
    losses = [h["val_loss"] for h in fit.history]
    assert min(losses) < 0.75 * losses[0]
    assert "gain" in model.head[-2] and "gain" not in model.head[-1]
    scored = score_folds(peptides.where("data_split = 'val'"), [model], "weighted_mean_three").select("value_bool", F.col("fold_scores")["fold1"].alias("p")).toPandas()
    p, y = scored.p.clip(1e-12, 1 - 1e-12), scored.value_bool
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    assert loss == pytest.approx(min(losses), rel=1e-6)
    _, again = gradient.fit_attention(peptides.coalesce(1), **{**kwargs, "epochs": 3})
    assert [h["train_loss"] for h in again.history] == pytest.approx([h["train_loss"] for h in fit.history[:3]])


def test_mlp_gradient_by_finite_differences():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(9, 4)), rng.normal(size=9)
    params = [rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]
    got, flat = gradient.pack(gradient.mlp_gradient(params, x, y)[0]), gradient.pack(params)
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        f = lambda z: gradient.mlp_gradient(gradient.unpack(z, params), x, y)[1].sum()
        assert got[i] == pytest.approx((f(up) - f(down)) / 2e-6, abs=1e-4)


@pytest.fixture(scope="module")
def peptides(spark):
    """Label 1 where the peptide is mostly hydrophobic."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        y = i % 2
        pool = "VILFAM" if y else "DEKRNQ"
        s = "".join(rng.choice(list(pool + "GST"), size=rng.integers(5, 20)))
        rows.append((i, s, float(y), "val" if i % 5 == 0 else "test" if i % 5 == 1 else "train"))
    return spark.createDataFrame(rows, "seq_id long, sequence string, value_bool double, data_split string")


def test_fit_attention_learns(peptides):
    model, fit = gradient.fit_attention(
        peptides, kernel=3, channels=3, head="linear", optimizer="adam", rate=0.1, epochs=25, patience=25
    )
    losses = [h["train_loss"] for h in fit.history]
    assert losses[-1] < losses[0] and 0.0 <= model.cutoff <= 1.0
    assert fit.history[fit.best_epoch]["val_loss"] == min(h["val_loss"] for h in fit.history)


def test_gradient_sum_does_not_depend_on_partitions(peptides):
    kwargs = dict(kernel=3, channels=2, epochs=2, patience=5)
    _, a = gradient.fit_attention(peptides.coalesce(1), **kwargs)
    _, b = gradient.fit_attention(peptides.repartition(6), **kwargs)
    assert [h["train_loss"] for h in a.history] == pytest.approx([h["train_loss"] for h in b.history])


def test_early_stop(peptides):
    _, fit = gradient.fit_attention(peptides, kernel=1, channels=1, rate=0.0, epochs=30, patience=2)
    assert len(fit.history) == 3 and fit.best_epoch == 0


def test_training_needs_both_splits(peptides):
    with pytest.raises(ValueError, match="train and val"):
        gradient.fit_attention(peptides.where("data_split = 'train'"))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        x = rng.normal(size=5)
        y = float(x[0] + 0.5 * x[1] + 0.1 * rng.normal() > 0)
        real = float(2.0 * x[0] - x[2] + 0.05 * rng.normal())
        rows.append((i, x.tolist(), y, real, float(x[3]), "ab"[i % 2], ["train", "train", "train", "val", "test"][i % 5]))
    return spark.createDataFrame(
        rows,
        "seq_id long, embedding array<double>, value_bool double, value_real double, data_num double, data_cat string, data_split string",
    )


def test_grid_finds_a_separating_model(spark, table):
    train = table.select("seq_id", F.col("embedding").alias("features"), F.col("value_bool").alias("y"))
    result = linear.logreg_grid_cv(train, c_values=(0.01, 1.0), n_splits=3, class_weight="balanced", max_iter=300)
    assert len(result.table) == 4 and {r["rank_test_score"] for r in result.table} >= {1}
    best = max(r["mean_test_score"] for r in result.table)
    assert best > 0.8 and len([k for k in result.table[0] if k.startswith("split")]) == 3
    scored = linear.logreg_score(train, result.model)
    assert scored.where("(y_pred = 1) <> (y_pred_prob > 0.5)").count() == 0
    assert scored.where("y_pred = y").count() > 360


def test_l2_fit_is_the_optimum(table):
    """At the optimum the gradient of C * sum of losses + half squared norm is zero."""
    train = table.select(F.col("embedding").alias("f"), F.col("value_bool").alias("y"), F.lit(1.0).alias("w"))
    from pyspark.ml.functions import array_to_vector

    n = train.count()
    model = linear.fit_logreg(train.withColumn("x", array_to_vector("f")), 0.5, "l2", float(n))
    x = np.array([r["f"] for r in train.collect()])
    y = np.array([r["y"] for r in train.collect()])
    w = np.array(model.coefficients)
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert np.abs(0.5 * x.T @ (p - y) + w).max() < 1e-2
    assert abs((p - y).sum()) < 1e-2


def test_pca(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 2)) * [5.0, 1.0]
    x = np.column_stack([base, base @ [[0.3], [0.1]], rng.normal(size=(300, 1)) * 0.01])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "seq_id long, embedding array<double>")
    found = fit_pca(df, "embedding", 0.99)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert found.explained == pytest.approx(s**2 / (s**2).sum(), abs=1e-9)
    assert found.n_components == components_needed(list(s**2 / (s**2).sum()), 0.99, 4) == 2
    assert np.abs(found.weights.T @ found.weights - np.eye(2)).max() < 1e-9
    rows = apply_pca(df, "embedding", found).orderBy("seq_id").collect()
    got = np.array([r["components"] for r in rows])
    assert np.abs(np.abs(got) - np.abs(x @ vt[:2].T)).max() < 1e-8  # uncentred, sign free


def test_categories(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    encoder = features.fit_categorical(df, "c")
    dense = encoder.attach(df, "i").select("c", encoder.one_hot(F.col("i")).alias("v"), encoder.sparse(F.col("i")).alias("s"))
    assert {r["c"]: (r["v"], tuple(r["s"])) for r in dense.collect()} == {
        "b": ([0, 1], (2, [1], [1.0])),
        "a": ([1, 0], (2, [0], [1.0])),
    }
    for unknown in ("z", None):
        with pytest.raises(Exception, match="unknown category"):
            encoder.attach(spark.createDataFrame([(unknown,)], "c string"), "i").collect()
    none = features.fit_categorical(df.where("c = 'q'"), "c")
    assert none.size == 0 and none.rows.count() == 0


def test_many_categories_and_a_frequent_one(spark):
    """A table of categories has no cap; rows of a frequent one are spread."""
    df = spark.range(120_000).select(
        "id", F.when(F.col("id") % 3 == 0, "often").otherwise(F.format_string("c%06d", F.col("id") % 50_000)).alias("a.b")
    )
    encoder = features.fit_categorical(df, "a.b")
    names = sorted(r[0] for r in df.select("`a.b`").distinct().collect())
    assert encoder.size == len(names) > 49_000 and encoder.frequent == ["often"]
    got = {r["category"]: r["index"] for r in encoder.rows.collect()}
    assert got == {c: i for i, c in enumerate(names)}
    attached = encoder.attach(df, "index")
    assert attached.columns == ["id", "a.b", "index"] and attached.count() == 120_000
    assert attached.where(F.col("`a.b`") == "often").select("index").distinct().collect()[0][0] == got["often"]


def test_layers_and_missing_embeddings(spark):
    docs = spark.createDataFrame([(1, "ACD"), (2, "K")], "seq_id long, sequence string")
    stack = spark.createDataFrame([(1, [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]])], "vec_id long, layers array<array<double>>")
    joined, missing = features.attach_embeddings(
        docs, stack, "seq_id", "vec_id", "layers", layer=-1, n_layers=2, cut_to=F.length("sequence")
    )
    assert joined.first()["embedding"] == [5.0, 6.0, 7.0] and [r[0] for r in missing.collect()] == [2]
    with pytest.raises(ValueError):
        features.attach_embeddings(docs, stack, "seq_id", "vec_id", "layers", layer=2, n_layers=2)


def test_pipeline_with_features_is_saved_and_loaded(spark, table, tmp_path):
    config = PipelineConfig(
        embedder="Precomputed",
        dimred="PCADimReduction",
        predictor_options={"c_values": (1.0,), "penalties": ("l2",), "n_splits": 2, "max_iter": 100},
        add_data_columns=True,
        data_columns_dimred=["data_num"],
        standardize_embedding=True,
        data_name="my_data",
    )
    fitted = compose_pipeline(table, config)
    assert config.model_name() == "Precomputed_LogisticRegression_mydata"
    out = fitted.apply(table)
    # 5 dims + 10 kernels reduced, then 2 categories
    assert len(out.first()["features"]) == fitted.dimred_state.n_components + 2
    test = out.where("data_split = 'test'")
    assert test.where("y_pred = y").count() / test.count() > 0.8
    path = str(tmp_path / "model")
    save_pipeline(spark, fitted, path)
    again = load_pipeline(spark, path).apply(table)
    a = {r["seq_id"]: r["y_pred_prob"] for r in out.collect()}
    assert {r["seq_id"]: r["y_pred_prob"] for r in again.collect()} == pytest.approx(a)
    with pytest.raises(FileExistsError):
        save_pipeline(spark, fitted, path)


def test_a_half_written_model_is_never_loaded(spark, tmp_path, monkeypatch):
    from seqloom.plans import pipeline

    nothing = {"add": [], "standard": [], "dimred": []}
    none = pipeline.Scaler("none", {}, {})
    config = PipelineConfig(embedder="Precomputed", dimred="PCADimReduction", predictor="LogisticRegression")
    weights = np.random.default_rng(1).normal(size=(2000, 600))  # over one piece
    reduced = pipeline.Components(weights, [0.5, 0.25])
    fitted = pipeline.FittedPipeline(config, nothing, {}, {}, None, None, none, reduced, linear.LinearModel([1.0, 2.0], 0.5))
    path = tmp_path / "model"
    write, left = pipeline._text, [1]

    def breaks_off(spark, value, to):
        if not left[0]:
            raise RuntimeError("lost")
        left[0] -= 1
        write(spark, value, to)

    monkeypatch.setattr(pipeline, "_text", breaks_off)
    with pytest.raises(RuntimeError, match="lost"):
        save_pipeline(spark, fitted, str(path))
    with pytest.raises(FileNotFoundError):
        load_pipeline(spark, str(path))
    monkeypatch.setattr(pipeline, "_text", write)
    save_pipeline(spark, fitted, str(path))
    again = load_pipeline(spark, str(path))
    assert (again.dimred_state.weights == weights).all() and again.predictor_state.coefficients == [1.0, 2.0]
    part = next((path / "dimred").glob("part-*"))
    part.write_bytes(part.read_bytes()[:-1])
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="manifest"):
        load_pipeline(spark, str(path))


def test_regression_pipeline_restores_the_target(table):
    config = PipelineConfig(
        embedder="Precomputed",
        predictor="TorchMLP",
        task="regression",
        target_scaling="StandardScaler",
        predictor_options={"hidden": 8, "rate": 0.05, "epochs": 40, "patience": 40},
    )
    fitted = compose_pipeline(table, config)
    error = fitted.apply(table).agg(F.avg(F.abs(F.col("y") - F.col("y_pred")))).first()[0]
    spread = table.agg(F.avg(F.abs("value_real"))).first()[0]
    assert error < 0.5 * spread


def test_attention_pipeline(spark, peptides, tmp_path):
    config = PipelineConfig(
        embedder_options={"mean_pool": False},
        predictor="LightAttention",
        predictor_options={"residue": True, "kernel": 3, "channels": 2, "epochs": 3, "patience": 3, "mode": "mean"},
    )
    fitted = compose_pipeline(peptides, config)
    out = fitted.apply(peptides)
    row = out.first()
    assert 0 <= row["y_pred_prob"] <= 1 and len(row["residue_scores"]) == len(row["sequence"])
    save_pipeline(spark, fitted, str(tmp_path / "m"))
    again = load_pipeline(spark, str(tmp_path / "m")).apply(peptides)
    assert {r["seq_id"]: r["y_pred_prob"] for r in again.collect()} == {r["seq_id"]: r["y_pred_prob"] for r in out.collect()}


def test_stage_registry():
    register_stage("embedder", "Custom", Stage(lambda df, o: None, lambda df, s, o: df))
    assert stage("embedder", "Custom")
    with pytest.raises(ValueError, match="registered"):
        stage("dimred", "Nothing")
    with pytest.raises(ValueError):
        register_stage("sink", "x", stage("embedder", "Custom"))


def test_validation_rows_cost_no_gradient(monkeypatch):
    """Held rows are only scored; a norm in front of the last layer is never written out."""
    rng = np.random.default_rng(4)
    pieces = pieces_of(rng, [6, 5])
    params = gradient.init_attention(5, 2, 3, "mlp", 1, rng)
    params = [*params[:-1], np.ones(32), np.zeros(32), params[-1]]
    how = gradient.Training("zscale", "weighted_mean_three", 0.0, {0: 4.0, 2: 4.0})
    plain, backward = gradient.am.pool_gradient, []
    monkeypatch.setattr(gradient.am, "pool_gradient", lambda *a: backward.append(len(a[2])) or plain(*a))
    _, stats, _ = gradient.training_step(sum_of(pieces), params, how, 0, (np.zeros(32), np.ones(32)))
    assert stats[3] > 0 and sum(backward) == 2 * stats[1]
    backward.clear()
    _, stats, _ = gradient.training_step(sum_of(pieces), [*params[:-3], params[-1]], how, 0, None)
    assert stats[3] > 0 and sum(backward) == stats[1]
