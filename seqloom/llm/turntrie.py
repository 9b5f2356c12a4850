"""Prefix trie of conversations with subtree totals by a depth-band rollup.

Every conversation is rebuilt first: up to three turns are borrowed from the conversation
whose id is the next smaller multiple of 20 (towards zero), so that many begin alike. A
node of depth d is a distinct sequence of d turns (role, text); its members are the
rebuilt conversations that begin with it, and it is named by its smallest member and its
depth. Prefixes are recognised by 128 bits: the running exclusive or of the MD5 digests of
(depth, role, text). Runs of ``RUN`` turns are summed by themselves and then chained, so a
conversation of any length is spread over tasks.

Subtree totals: depths are cut into bands of ``BAND``. Within its band a node's value goes
to each of its ancestors there; what a conversation adds to an ancestor is summed along the
conversation before anything is shuffled, so a band makes no more rows than it has turns.
Then the tops of the bands, which know their totals within the band, are a trie of their
own, ``BAND`` times flatter. It is rolled up in the same way, and each completed total goes
to the ancestors in the band above its top. Rounds grow with the logarithm of the depth and
a row is multiplied by ``BAND`` at most.

Defined results: null role or text is empty; ties of turn go by role, then text; repeated
rows are turns of their own; a conversation left without turns is a member of the root
only. Rows without conv_id belong to no conversation and are left out. Without any
conversation there is no root and the result is empty. A conversation, a first turn or a
list of ends may hold most rows; only the hash of one node's ends is one stream, in
pieces of bounded size. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_width
from .common import arrow, prepare, written
from .turns import WORD, numbered

#: Conversations that borrow from the same one; most turns borrowed, plus one.
FAMILY = 20
BORROWED = 4
BAND = 16
#: Turns of one conversation whose digests are chained in one task.
RUN = 1024
#: Ids of a node's ends that are joined into one string.
ENDS = 4096


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, role, text) and conversations (conv_id, length) after borrowing."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    own = written(numbered(turns).drop("turn"), "turns")
    c = F.col("conv_id")
    ids = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    ids = ids.select("conv_id", "n", (c - c % FAMILY).alias("giver"), (F.crc32(c.cast("string")) % BORROWED).alias("h"))
    givers = ids.where(c % FAMILY == 0).select(F.col("conv_id").alias("giver"), F.col("n").alias("has"))
    ids = ids.join(givers, "giver", "left").select(
        "conv_id", "giver", "h", "n", F.least("h", F.coalesce("has", F.lit(0))).alias("got")
    )
    ids = written(ids.withColumn("length", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "ids")
    given = own.where((c % FAMILY == 0) & (F.col("no") < BORROWED)).select(
        F.col("conv_id").alias("giver"), F.col("no").alias("depth"), "role", "text"
    )
    borrowed = ids.where("got > 0").select("conv_id", "giver", "h", "length").join(given, "giver").where("depth <= h")
    kept = own.join(ids.select("conv_id", "h", "got", "length"), "conv_id").where("no > h")
    kept = kept.withColumn("depth", F.col("no") - F.col("h") + F.col("got"))
    columns = ["conv_id", "depth", "role", "text", "length"]
    return borrowed.select(columns).unionByName(kept.select(columns)), ids.select("conv_id", "length")


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Turns with two longs that name the prefix up to each: conv_id, depth, length, words, x, y."""
    digest = F.md5(F.concat_ws(":", F.col("depth"), F.octet_length("role"), "role", "text").cast("binary"))
    marked = turns.select(
        "conv_id", "depth", "length",
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
        F.floor((F.col("depth") - 1) / RUN).alias("run"),
        digest.alias("digest"),
    ).select("conv_id", "depth", "length", "words", "run", _half(F.col("digest"), 1).alias("x"), _half(F.col("digest"), 17).alias("y"))
    marked = written(marked, "marked")
    inside = Window.partitionBy("conv_id", "run").orderBy("depth")
    own = marked.withColumns({k: F.bit_xor(k).over(inside) for k in "xy"})
    # The runs before, of the conversations that have more than one.
    sums = marked.where("length > " + str(RUN)).groupBy("conv_id", "run").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "run", F.bit_xor("x").over(before).alias("bx"), F.bit_xor("y").over(before).alias("by"))
    none = F.lit(0).cast("long")
    return own.join(carried, ["conv_id", "run"], "left").select(
        "conv_id", "depth", "length", "words",
        F.col("x").bitwiseXOR(F.coalesce("bx", none)).alias("x"),
        F.col("y").bitwiseXOR(F.coalesce("by", none)).alias("y"),
    )


def _paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation's nodes, the root included: conv_id, depth, length, node, n, ends, words.

    ``node`` is the node's smallest member, ``n`` its members, ``far`` the longest one's length.
    """
    prefixes = _prefixes(turns)
    key = ["depth", "x", "y"]
    shared = prefixes.groupBy(*key).agg(
        F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), F.max("length").alias("far")
    )
    named = prefixes.join(shared.where("n > 1"), key, "left").select(
        "conv_id", "depth", "length", "words",
        F.coalesce("node", "conv_id").alias("node"),
        F.coalesce("n", F.lit(1)).alias("n"),
        F.coalesce("far", "length").alias("far"),
    )
    first, n, far = ids.agg(F.min("conv_id"), F.count(F.lit(1)), F.max("length")).first()
    zero = F.lit(0).cast("long")
    root = ids.select(
        "conv_id", zero.alias("depth"), "length", zero.alias("words"),
        F.lit(first).cast("long").alias("node"), F.lit(n).alias("n"), F.lit(far).cast("long").alias("far"),
    )
    return written(named.unionByName(root), "paths")


def subtree_sums(paths: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """Sums over subtrees: node, depth and ``values``.

    ``paths`` has conv_id, depth and node of every conversation at every depth, and the
    values of a node on the row of the conversation that names it, 0 on the others.
    """
    within = Window.partitionBy("conv_id", F.floor(F.col("depth") / band)).orderBy(F.desc("depth"))
    below = paths.select("node", "depth", *[F.sum(v).over(within).alias(v) for v in values])
    sums = [F.sum(v).alias(v) for v in values]
    inside = below.groupBy("node", "depth").agg(*sums)
    deepest = paths.agg(F.max("depth")).first()[0]
    if deepest is None or deepest < band:
        return inside
    inside = written(inside, "inside")
    # Tops of bands: a trie of their own, whose values are the totals of their bands.
    tops = inside.where(F.col("depth") % band == 0).withColumnRenamed("node", "conv_id")
    ways = paths.where(F.col("depth") % band == 0).select("conv_id", "depth", "node")
    ways = ways.join(tops, ["conv_id", "depth"], "left").select(
        "conv_id",
        (F.col("depth") / band).cast("long").alias("depth"),
        "node",
        *[F.when(F.col("node") == F.col("conv_id"), F.coalesce(v, F.lit(0))).otherwise(0).alias(v) for v in values],
    )
    whole = subtree_sums(written(ways, "tops"), values, band).where("depth > 0")
    # A completed total goes to the ancestors in the band above.
    up = whole.select(
        F.col("node").alias("conv_id"),
        F.explode(F.sequence((F.col("depth") - 1) * band, F.col("depth") * band - 1)).alias("depth"),
        *values,
    )
    above = up.join(paths.select("conv_id", "depth", "node"), ["conv_id", "depth"]).groupBy("node", "depth").agg(*sums)
    return inside.unionByName(above).groupBy("node", "depth").agg(*sums)


def _ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids (conv_id) that end at each (node, depth), in order and comma-joined."""
    spark = ends.sparkSession
    prepare(spark)
    width = shuffle_width(spark)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            node, depth, conv = (batch.column(c).to_numpy() for c in ("node", "depth", "conv_id"))
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])])
            heads = np.flatnonzero(new)
            heads = np.unique(np.concatenate([heads, np.arange(0, len(node), ENDS)]))
            ids = conv.astype(str).tolist()
            joined = [",".join(ids[i:j]) for i, j in zip(heads, [*heads[1:], len(ids)], strict=True)]
            yield arrow(["node", "depth", "first", "ids"], [node[heads], depth[heads], conv[heads], joined])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found: list[tuple[int, int, str]] = []
            for node, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("node", "depth", "ids")], strict=True):
                if (node, depth) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    found.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256(ids.encode())
            if found:
                yield arrow(["node", "depth", "sha"], list(zip(*found, strict=True)))
        if key is not None:
            yield arrow(["node", "depth", "sha"], [[key[0]], [key[1]], [state.hexdigest()]])

    order = ["node", "depth", "conv_id"]
    sorted_ = ends.select(order).repartitionByRange(width, *order).sortWithinPartitions(*order)
    cut = sorted_.mapInArrow(pieces, "node long, depth long, first long, ids string")
    dealt = cut.repartition(width, "node", "depth").sortWithinPartitions("node", "depth", "first")
    return dealt.mapInArrow(hashes, "node long, depth long, sha string")


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node with its subtree's totals; see the module's text for names and rules."""
    turns, ids = rebuilt(conversations)
    paths = _paths(turns, ids)
    named = F.col("node") == F.col("conv_id")
    own = paths.where(named)
    valued = paths.select(
        "conv_id", "depth", "node",
        F.when(named & (F.col("depth") == F.col("far")), 1).otherwise(0).cast("long").alias("n_leaves"),
        F.when(named, (F.col("n") - 1) * F.col("words")).otherwise(0).alias("saved_tokens"),
    )
    totals = subtree_sums(valued, ["n_leaves", "saved_tokens"], band)
    parents = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    nodes = own.join(parents, ["conv_id", "depth"], "left").select("node", "depth", "parent_conv_id", F.col("n").alias("n_convs"))
    nodes = written(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    ends = _ends(paths.where("depth = length"))
    # Each part has a row for some of the nodes: one shuffle brings them together.
    parts = nodes
    for part in (totals, children, ends):
        parts = parts.unionByName(part, allowMissingColumns=True)
    nothing = hashlib.sha256(b"").hexdigest()
    return parts.groupBy(F.col("node").alias("conv_id"), "depth").agg(
        F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        F.coalesce(F.max("n_children"), F.lit(0)).cast("long").alias("n_children"),
        F.max("n_leaves").alias("n_leaves"),
        F.max("saved_tokens").alias("saved_tokens"),
        F.coalesce(F.max("sha"), F.lit(nothing)).alias("ends_sha256"),
    )
