"""Approximate nearest neighbours by a hash-prefix forest (largest inner product).

Vectors get one more component, the square root of what their squared length lacks
to the longest, which turns inner products into angles. Each tree hashes a vector
to a string of ``BITS`` signs of projections on its own random directions, and
keeps the strings in a sorted array, where all vectors with a common prefix are
neighbours. A query descends every tree to its longest prefix match; then all
trees ascend together, one bit at a time, until the ranges that share a prefix of
that length hold ``share`` times the shard's vectors and at least ``LEAST``, counted over
all trees. All vectors in the ranges are candidates; none is dropped. They are ranked by their
exact inner product.

The forest is built in shards of a bounded number of vectors, and the queries meet
every shard in blocks of bounded size, so a task holds one shard and one block
whatever the number of rows. Equal vectors are indexed once, with the ids that can
still be among the nearest.

Defined results: vectors that are null, of no component, all zero, or with a null
or non-finite component take no part, as query or candidate, and so do rows
without id; vectors of another length than the most frequent one take no part
either; ties go to the smaller id; repeated rows with one id count once; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written

BITS = 24
TREES = 192
#: The trees ascend until their ranges hold, counted over all trees, so many times the
#: shard's vectors, and at least so many vectors.
SHARE = 0.3
LEAST = 4096
NEAREST = 20
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096


def usable(vector: Column) -> Column:
    """Not null, some component not 0, all of them finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted hash strings of one shard's vectors, one array per tree."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES, seed: int = 5):
        self.vectors = vectors
        self.trees = trees
        self._longest = longest
        rng = np.random.default_rng(seed)
        self._directions = rng.standard_normal((vectors.shape[1] + 1, trees * BITS))
        lack = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        keys = self._strings(np.column_stack([vectors, lack]))
        self._order = np.argsort(keys, axis=1).astype(np.int32)
        self._keys = np.take_along_axis(keys, self._order, 1)

    def _strings(self, rows: np.ndarray) -> np.ndarray:
        """[tree, row]: BITS signs as an integer, the first sign leading."""
        out = np.zeros((self.trees, len(rows)), np.int32)
        weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int32)
        for t in range(self.trees):
            signs = rows @ self._directions[:, t * BITS : (t + 1) * BITS] > 0
            out[t] = signs @ weight
        return out

    def _ranges(self, keys: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[tree, query]: where the strings with the query's prefix of ``depth`` bits stand."""
        rest = BITS - depth
        low = (keys >> rest) << rest
        high = low + (1 << rest)
        first = np.stack([np.searchsorted(k, x) for k, x in zip(self._keys, low, strict=True)])
        last = np.stack([np.searchsorted(k, x) for k, x in zip(self._keys, high, strict=True)])
        return first, last

    def candidates(self, queries: np.ndarray, least: float) -> Iterator[np.ndarray]:
        """Candidates of each query: at least ``least`` over all trees, if there are."""
        keys = self._strings(np.column_stack([queries, np.zeros(len(queries))]))
        # The deepest depth whose ranges hold enough; fewer bits never hold less.
        shallow = np.zeros(len(queries), np.int32)
        deep = np.full(len(queries), BITS, np.int32)
        while (shallow < deep).any():
            middle = (shallow + deep + 1) // 2
            first, last = self._ranges(keys, middle)
            enough = (last - first).sum(0) >= least
            shallow = np.where(enough, middle, shallow)
            deep = np.where(enough, deep, middle - 1)
        first, last = self._ranges(keys, shallow)
        mark = np.zeros(len(self.vectors), bool)
        for q in range(len(queries)):
            mark[:] = False
            for t in range(self.trees):
                mark[self._order[t, first[t, q] : last[t, q]]] = True
            yield np.flatnonzero(mark)


def search(vectors: np.ndarray, queries: np.ndarray, longest: float, nearest: int, share: float):
    """For each query the best vectors of this shard: numbers and exact inner products."""
    forest = Forest(vectors, longest)
    least = max(share * len(vectors), LEAST)
    for query, found in zip(queries, forest.candidates(queries, least), strict=True):
        score = vectors[found] @ query
        if len(found) > nearest:
            # Everything that ties with the last place stays.
            edge = np.partition(score, len(score) - nearest)[len(score) - nearest]
            keep = score >= edge - 1e-12 * max(abs(edge), 1.0)
            found, score = found[keep], score[keep]
        yield found, score


def nearest_neighbours(
    rows: DataFrame, is_query: Column, nearest: int = NEAREST, share: float = SHARE
) -> DataFrame:
    """query_id, rank, vec_id and score; ``rows`` has vec_id and embedding.

    Queries are the rows for which ``is_query`` holds; a query is not its own
    neighbour.
    """
    spark = rows.sparkSession
    prepare(spark)
    vectors = (
        rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("embedding").cast("array<double>").alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
        .dropDuplicates(["vec_id", "vector"])
    )
    sizes = vectors.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], result)
    vectors = vectors.where(F.size("vector") == common["d"])
    # A class of equal vectors is known by a digest of its components.
    key = F.md5(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary"))
    vectors = written(vectors.withColumn("class", key), "vectors")
    # One more than asked for: a query takes itself out.
    first = Window.partitionBy("class").orderBy("vec_id")
    ids = (
        vectors.select("class", "vec_id")
        .withColumn("no", F.row_number().over(first))
        .where(F.col("no") <= nearest + 1)
        .select("class", "vec_id")
    )
    distinct = written(
        vectors.groupBy("class").agg(F.first("vector").alias("vector"), F.max("asks").alias("asks")),
        "distinct",
    )
    facts = distinct.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("asks").cast("long")).alias("q"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("m"),
    ).first()
    n_shards = max(-(-facts["n"] // SHARD_ROWS), 1)
    n_blocks = max(-(-(facts["q"] or 0) // QUERY_ROWS), 1)
    longest = float(np.sqrt(facts["m"] or 0.0))

    place = F.xxhash64("class")
    indexed = distinct.select(
        "class",
        "vector",
        F.lit(False).alias("asks"),
        F.pmod(place, F.lit(n_shards)).cast("long").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
    )
    asking = distinct.where("asks").select(
        "class",
        "vector",
        "asks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64(F.reverse("class")), F.lit(n_blocks)).cast("int").alias("block"),
    )

    def best(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        out = {"query": [], "class": [], "score": []}
        if asks.any() and not asks.all():
            held = group["class"].to_numpy()[~asks]
            asked = group["class"].to_numpy()[asks]
            mine = np.stack(group["vector"].to_numpy()[~asks]).astype(np.float64)
            wanted = np.stack(group["vector"].to_numpy()[asks]).astype(np.float64)
            for name, (found, score) in zip(
                asked, search(mine, wanted, longest, nearest + 1, share), strict=True
            ):
                out["query"] += [name] * len(found)
                out["class"] += held[found].tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out)

    hits = (
        indexed.unionByName(asking)
        .groupBy("shard", "block")
        .applyInPandas(best, "query string, class string, score double")
    )
    # Classes first: only the best of them can hold one of the nearest ids.
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    hits = hits.withColumn("place", F.rank().over(order)).where(F.col("place") <= nearest + 1)
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = (
        hits.join(ids, "class")
        .withColumn("place", F.row_number().over(by_id))
        .where(F.col("place") <= nearest + 1)
        .select("query", "vec_id", "score", "place")
    )
    askers = vectors.where("asks").select(F.col("class").alias("query"), F.col("vec_id").alias("query_id"))
    answers = answers.join(askers, "query")
    # At most nearest + 1 rows per asking row: those before its own id move up by none, those after by one.
    own = answers.where("vec_id = query_id").select("query_id", F.col("place").alias("own"))
    return (
        answers.where("vec_id != query_id")
        .join(own, "query_id", "left")
        .select(
            "query_id",
            (F.col("place") - F.when(F.col("place") > F.col("own"), 1).otherwise(0)).cast("int").alias("rank"),
            "vec_id",
            "score",
        )
        .where(F.col("rank") <= nearest)
    )
