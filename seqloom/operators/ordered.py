"""Running sums, exact ranks and exact quantiles without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width

HASH_BITS = 60
BUCKET_BITS = 12


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys come from the left."""
    if not keys:
        return left.join(right, how=how)
    right = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    return left.join(right, same, how).drop(*[f"_same_{k}" for k in keys])


def running_sums(
    df: DataFrame, keys: list[str], order: str, sums: list[str], descending: bool = False
) -> DataFrame:
    """Add ``cum_x`` (inclusive) and ``total_x`` per key for each column in ``sums``.

    Rows must be unique in (keys, order): aggregate them first. One key may
    hold most rows, so a window over the whole key is avoided. Rows are
    range-partitioned by (keys, order), each partition sums its own stretch of
    a key, and the stretch totals, one row per partition and key, give every
    stretch its starting value. The checkpoint pins the range bounds, which are
    sampled and could differ if they were computed twice.
    """
    by = [F.col(k) for k in keys]
    along = F.col(order).desc() if descending else F.col(order).asc()
    width = shuffle_width(df.sparkSession)
    placed = cut_lineage(
        df.repartitionByRange(width, *by, along).withColumn("_part", F.spark_partition_id())
    )

    stretches = placed.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    per_key = Window.partitionBy(*by)
    earlier = per_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stretches.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(f"_s_{s}").over(earlier), F.lit(0)).alias(f"_b_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(per_key).alias(f"total_{s}") for s in sums],
    )
    inside = (
        Window.partitionBy(*by, "_part")
        .orderBy(along)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = placed.withColumns({f"_i_{s}": F.sum(s).over(inside) for s in sums})
    joined = join_same(summed, starts, [*keys, "_part"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_b_{s}") + F.col(f"_i_{s}")).alias(f"cum_{s}") for s in sums],
        *[f"total_{s}" for s in sums],
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float]
) -> DataFrame:
    """Linear-interpolated quantiles per key as columns ``q0, q1, ...``.

    Works on counts per distinct value, so no task ever buffers a whole column.
    """
    counts = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_sums(counts, keys, value, ["n"])
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    covers, picks = F.lit(False), []
    for i, p in enumerate(probs):
        target = F.lit(float(p)) * (F.col("total_n") - 1)
        low, high = F.floor(target), F.ceil(target)
        in_low = (first <= low) & (low <= last)
        in_high = (first <= high) & (high <= last)
        covers = covers | in_low | in_high
        picks += [
            F.max(F.when(in_low, F.col(value))).alias(f"_l{i}"),
            F.max(F.when(in_high, F.col(value))).alias(f"_h{i}"),
            F.max(target - low).alias(f"_f{i}"),
        ]
    picked = ranked.where(covers).groupBy(*keys).agg(*picks)
    return picked.select(
        *keys,
        *[
            (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
            for i in range(len(probs))
        ],
    )


def seeded_hash(key: Column, seed: int) -> Column:
    """60-bit hash of (seed, key), the same in any engine that has md5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def seeded_rank(df: DataFrame, key: str, seed: int, within: list[str] | None = None) -> DataFrame:
    """Add ``_rank`` (0-based, exact) in seeded-hash order and ``_total`` per stratum.

    The leading hash bits cut each stratum into 4096 even buckets. Only the
    bucket counts are ordered globally; rows are numbered inside their bucket.
    """
    stratum = F.to_json(F.struct(*within)) if within else F.lit("")
    hashed = df.withColumns(
        {"_h": seeded_hash(F.col(key), seed), "_stratum": stratum}
    ).withColumn("_bucket", F.shiftright("_h", HASH_BITS - BUCKET_BITS))
    counts = hashed.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_stratum")
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_stratum",
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_stratum", "_bucket").orderBy("_h", key)
    numbered = hashed.withColumn("_no", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, ["_stratum", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_no"))
        .select(*df.columns, "_rank", "_total")
    )
