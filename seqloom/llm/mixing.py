"""Mix sources to target token weights by entropy balancing.

Each token of a document carries the document's rate. Among all rates that give
every source its target, the balanced ones stay closest in entropy to one copy of
everything; they have the form exp(lambda_source), and lambda solves a convex dual
by Newton steps whose gradient and curvature are sums over all documents. The
rates are then rounded into copies: documents of one source and size are a class,
classes are taken from the largest size down, and each passes its rounding error
on, so a source ends within about one small document of its target. Inside a
class the documents with the smallest hash of id and text get the extra copy; of rows
that are equal in both, and so have one hash, as many as are due get it.

Defined results: a null text has size 0 and takes 0 words; a null source is a
source of its own, last in order; repeated rows, and rows without or with the same id,
are documents of their own, whose copies differ by one at most if their sizes do not; a
very long text is one document of its size; a source of size 0 has target 0; an empty
table gives an empty result. Other columns are kept
by ``mixed_documents`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_sums
from .common import prepare, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No target, and no document's taken words, go beyond so many times the size.
MOST = 3
BUCKET_BITS = 10
#: Rounding plans of at most so many classes are broadcast; larger ones are joined by key.
BROADCAST_CLASSES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Not null, and in the order of the sources: code points, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _hash(doc_id: Column, text: Column) -> Column:
    none = F.lit("")
    return F.xxhash64(F.coalesce(doc_id.cast("string"), none), F.coalesce(text, none))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        _key(F.col("source")).alias("source_key"),
        n_words(F.col("text")).alias("size"),
        _hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )


def source_targets(classes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source_key, source_size and target from rows (source_key, size, n).

    Reached in rounds: with the level fixed, a source gets level * weight but at
    most MOST times its size; what the full ones leave raises the level. Each
    round is one aggregate over one row per source.
    """
    per_source = classes.groupBy("source_key").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size")
    )
    ranked = running_sums(
        per_source.withColumns({"all": F.lit(1), "one": F.lit(1)}), ["all"], "source_key", ["one"]
    )
    choice = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        ((F.col("cum_one") - 1) % len(weights) + 1).cast("int"),
    )
    sources = written(ranked.select("source_key", "source_size", choice.alias("weight")), "sources")
    level, full = 0.0, -1
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        is_full = F.lit(level) * F.col("weight") >= MOST * F.col("source_size")
        row = sources.agg(
            F.sum(is_full.cast("int")).alias("full"),
            F.sum(F.when(is_full, F.col("source_size")).otherwise(0)).alias("size"),
            F.sum(F.when(is_full, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not row["weight"] or row["full"] == full:
            break
        full, level = row["full"], (total - MOST * row["size"]) / row["weight"]
    target = F.least(F.lit(level) * F.col("weight"), (MOST * F.col("source_size")).cast("double"))
    return sources.select("source_key", "source_size", target.alias("target"))


def balanced_rates(classes: DataFrame, targets: DataFrame, steps: int = 40) -> DataFrame:
    """Add ``rate`` per source by Newton steps on the dual.

    The dual per source is sum(size * n * exp(lambda)) - lambda * target, summed
    over all its documents. A step down is at most 1, so exp cannot overshoot. The rate
    is one for all documents of a source, so exp(lambda) leaves the sum: the documents
    are summed once, and all steps are taken on one row per source, in one query.
    """
    held = classes.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("_held"))

    def newton(lam: Column, _: Column) -> Column:
        now = F.col("_held") * F.exp(lam)
        step = F.when(
            (now > 0) & (F.col("target") > 0),
            F.greatest(F.least((F.col("target") - now) / now, F.lit(2.0)), F.lit(-1.0)),
        ).otherwise(0.0)
        return lam + step

    lam = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), newton)
    rate = F.when(F.col("target") > 0, F.least(F.exp(lam), F.lit(float(MOST)))).otherwise(0.0)
    rates = targets.join(held, "source_key").select(*targets.columns, rate.alias("rate"))
    return written(rates, "rates")


def _rounded(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
    """Copies of each class of one source, the rounding error passed on downwards."""
    own = groups.sort_values("size", ascending=False)
    error, each, extra = 0.0, [], []
    for size, n, rate in zip(own["size"], own["n"], own["rate"], strict=True):
        want = n * rate * size + error
        copies = round(n * rate) if size == 0 else int(min(max(round(want / size), 0), MOST * n))
        error = want - copies * size
        each.append(copies // n)
        extra.append(copies % n)
    return own.assign(copies=each, extra=extra)[["source_key", "size", "copies", "extra"]]


def mixing_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per class (source_key, size): copies, and up to where an extra copy is given.

    Rows with a hash below ``bound`` get one, and ``due`` of the ``equal`` rows at it.
    ``rows`` is the written result of ``sized``. Ranks inside a class are taken in
    buckets of the hash, and there on counts of equal hashes, so neither a class nor a
    repeated row that holds a third of all rows lands in one task.
    """
    prepare(rows.sparkSession)
    bucket = F.shiftrightunsigned("hash", 64 - BUCKET_BITS)
    parts = written(
        rows.groupBy("source_key", "size", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
        "classes",
    )
    classes = parts.groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(classes, weights)
    rates = balanced_rates(classes, targets)
    # A group has one row for each distinct size of the source, however many documents.
    rounded = (
        classes.join(rates.select("source_key", "rate"), "source_key")
        .groupBy("source_key")
        .applyInPandas(_rounded, "source_key string, size long, copies int, extra long")
    )
    plan = written(
        rounded.join(rates.select("source_key", "source_size", "target"), "source_key"), "plan"
    )
    edges = _edge(parts, plan.where("extra > 0").select("source_key", "size", F.col("extra").alias("due")), [], "bucket")
    edges = edges.select("source_key", "size", "bucket", "due")
    equal = (
        rows.withColumn("bucket", bucket)
        .join(edges.drop("due"), ["source_key", "size", "bucket"])
        .groupBy("source_key", "size", "bucket", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bounds = _edge(equal, edges, ["bucket"], "hash").select(
        "source_key", "size", "bucket", F.col("hash").alias("bound"), F.col("n").alias("equal"), "due"
    )
    return plan.join(bounds, ["source_key", "size"], "left").drop("extra")


def _edge(counts: DataFrame, due: DataFrame, within: list[str], along: str) -> DataFrame:
    """The row of each class (and ``within``) in which its ``due``-th row lies; ``due`` then counts from it."""
    keys = ["source_key", "size", *within]
    before = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(due, keys)
        .where("before < due AND due <= before + n")
        .withColumn("due", F.col("due") - F.col("before"))
    )


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with (source_key, size, hash) and the copies the plan gives them."""
    plan = written(plan, "bounds")
    some = not plan.where("due < equal").isEmpty()
    if plan.count() <= BROADCAST_CLASSES:
        plan = F.broadcast(plan)
    bucket = F.shiftrightunsigned("hash", 64 - BUCKET_BITS)
    below = (bucket < F.col("bucket")) | ((bucket == F.col("bucket")) & (F.col("hash") < F.col("bound")))
    at = (F.col("hash") == F.col("bound")) & F.col("bound").isNotNull()
    placed = rows.join(plan, ["source_key", "size"])
    whole = placed.withColumn(
        "copies", F.col("copies") + (F.col("bound").isNotNull() & (below | (at & (F.col("due") == F.col("equal"))))).cast("int")
    )
    if not some:
        return whole
    # Equal rows of which some get an extra copy: any of them, as nothing tells them apart.
    split = at & (F.col("due") < F.col("equal"))
    whole = whole.where(~F.coalesce(split, F.lit(False)))
    tied = written(placed.where(split).withColumn("_row", F.monotonically_increasing_id()), "tied")
    part = F.shiftright("_row", 33).alias("_part")
    keys = ["source_key", "size"]
    counts = tied.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_row")
    numbered = tied.withColumn("_part", part).withColumn("_no", F.row_number().over(inside)).join(counts, [*keys, "_part"])
    extra = (F.col("_before") + F.col("_no") <= F.col("due")).cast("int")
    numbered = numbered.withColumn("copies", F.col("copies") + extra)
    return whole.unionByName(numbered.select(*whole.columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    rows = written(sized(docs), "sizes")
    mixed = _with_plan(rows, mixing_plan(rows, weights))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, all columns as they were."""
    plan = mixing_plan(written(sized(docs), "sizes"), weights)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = keyed.select(
        "row",
        _key(F.col("row.source")).alias("source_key"),
        n_words(F.col("row.text")).alias("size"),
        _hash(F.col("row.doc_id"), F.col("row.text")).alias("hash"),
    )
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    return _with_plan(rows, plan).select("row", times).select("row.*")
