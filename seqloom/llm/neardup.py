"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is the multiset of its five-word shingles; the weight of a shingle is
how often it occurs. The similarity is the probability Jaccard

    J(x, y) = sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)

which for equal weights is the plain Jaccard. ProbMinHash: each shingle emits a
Poisson process whose rate is its weight, every arrival falls on one of
``REGISTERS`` registers, and a register keeps its earliest arrival. Arrivals come
in waves, and a shingle stops as soon as its next arrival is later than every
register of its document (early termination). Registers are equal in two
documents with probability J.

A pair counts as near if the exact J, or the plain Jaccard of the two shingle sets, is
at least 0.8; the two differ only where shingles repeat inside a text. So a text with
repeated shingles has a second sketch with all weights 1; for any other text the two
sketches are one. ``BANDS`` bands of ``ROWS`` registers of each sketch give a document
its buckets; a pair at 0.8 by either measure shares none with probability 6e-5. A bucket is never expanded into pairs: its pivot
is its smallest document; each document is compared with the smallest pivot it meets,
and the links that verification confirms are joined into classes; then with a second
pivot. Where a bucket still holds several classes, its members outside the largest class
meet all its members in blocks of bounded size. In such a block equal registers estimate
both measures, and every pair of different classes whose larger estimate is at most
``SLACK``, five standard errors, short of the threshold is verified there, from sorted
shingle hashes that travel with the members. Pairs never leave their block: a pair is
looked at in the first band it shares, classes that meet in a block are one from then on,
and the block hands on one link for each two classes it joins, fewer than it has members.
So of the pairs that share a bucket only those that the estimate rules out are neither in
one class nor compared exactly. Exact copies collapse before that.

Defined results: null counts as the empty text; a text with one to four words is
one shingle of them all; a text without words is near to its exact copies only; repeated
rows share a class, whose id is its smallest document id; an empty table gives an
empty result. Classes are made of texts, keyed by their digests: rows with a null or a
repeated id and different texts that are not near stay in classes of their own, though
these bear the same id (null if no document of the class has one). Other columns are
kept by ``first_of_each_class``, which gives one row of every class, and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width
from .common import arrow, map_texts, prepare, written
from .textops import TEXT_BITS, Hasher, Texts, mix, shingles, slices, words

WIDTH = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 6
REGISTERS = BANDS * ROWS
PIVOT_ROUNDS = 2
#: Members of a bucket, and bytes of their texts, that meet at a time.
BLOCK = 256
BLOCK_BYTES = 8 << 20
#: How far an estimate may stay behind the threshold.
SLACK = 0.15
#: Pairs whose registers are compared at a time.
PAIRS = 1 << 17


def weighted_shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) in order, with counts: text, hash, count."""
    found = words(texts)
    hashes = Hasher(texts.data)(found.start, found.end) if len(found.start) else np.empty(0, np.uint64)
    shingle, text = shingles(hashes, found.of, WIDTH)
    if not len(shingle):
        return text, shingle, np.empty(0)
    # The text in the leading bits: one sort orders all texts. As many bits in every
    # slice, since a shingle's hash must not depend on the texts around it.
    bits, rest = np.uint64(TEXT_BITS), np.uint64(64 - TEXT_BITS)
    tagged = np.sort((text.astype(np.uint64) << rest) | (shingle >> bits))
    first = np.flatnonzero(np.concatenate([[True], tagged[1:] != tagged[:-1]]))
    count = np.diff(np.append(first, len(tagged))).astype(np.float64)
    own = tagged[first]
    return (own >> rest).astype(np.int64), own << bits, count


def registers(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """[text, register]: hash of the shingle that arrived first; 0 without shingles."""
    times = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, np.uint64)
    state = mix(shingle)
    arrival = np.zeros(len(shingle))
    active = np.arange(len(shingle))
    unit = 2.0**-53
    while len(active):
        state[active] = mix(state[active] + np.uint64(0x9E3779B97F4A7C15))
        draw = state[active]
        arrival[active] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * unit) / weight[active]
        register = (mix(draw ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(REGISTERS)).astype(np.int64)
        slot = text[active] * REGISTERS + register
        when = arrival[active]
        early = np.flatnonzero(when < times[slot])
        # Latest first, so that the earliest arrival of a register is written last.
        early = early[np.argsort(-when[early], kind="stable")]
        times[slot[early]] = when[early]
        winner[slot[early]] = shingle[active[early]]
        limit = times.reshape(n, REGISTERS).max(1)
        active = active[when < limit[text[active]]]
    return winner.reshape(n, REGISTERS)


def plain_registers(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Registers with all weights 1; ``found`` has those of the given weights."""
    repeats = np.bincount(text, weights=weight != 1, minlength=len(found)) > 0
    out = found.copy()
    if repeats.any():
        own = repeats[text]
        number = np.cumsum(repeats) - 1
        out[repeats] = registers(number[text[own]], shingle[own], np.ones(own.sum()), int(repeats.sum()))
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """[text, band]: one key per band, with the band's number as its last bits."""
    parts = found.reshape(len(found), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return (key & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, band keys (empty without words) and registers.

    Of a register a byte is kept: others agree by chance in 1 of 256. Those with all
    weights 1 follow where they are others.
    """

    def run(texts: Texts, rows: pa.RecordBatch) -> pa.RecordBatch:
        text, shingle, weight = weighted_shingles(texts)
        found = registers(text, shingle, weight, len(texts))
        keys = bands(found).view(np.int64)
        flat = plain_registers(text, shingle, weight, found)
        plain = bands(flat).view(np.int64)
        short, short_flat = ((mix(r) >> np.uint64(56)).astype(np.uint8) for r in (found, flat))
        repeats = (found != flat).any(1)
        kept = [r.tobytes() + f.tobytes() * bool(x) for r, f, x in zip(short, short_flat, repeats, strict=True)]
        has = np.bincount(text, minlength=len(texts)) > 0
        keys = np.concatenate([keys, plain], 1)
        use = np.concatenate([np.ones(plain.shape, bool), plain != keys[:, :BANDS]], 1) & has[:, None]
        offsets = np.concatenate([[0], np.cumsum(use.sum(1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[use]))
        return arrow(
            ["doc_id", "digest", "bands", "registers"],
            [rows.column("doc_id"), rows.column("digest"), lists, pa.array(kept, pa.binary())],
        )

    rows = docs.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    return map_texts(rows, run, "doc_id long, digest string, bands array<long>, registers binary")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact value from two sorted (shingle, weight) pairs of arrays."""
    both, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][at], b[1][bt]
    only_a = a[1].sum() - x.sum()
    only_b = b[1].sum() - y.sum()
    # 1 / x_i times sum_j max(x_j, y_j * r) with r = x_i / y_i; few values of r occur.
    total = 0.0
    ratio = x / y
    for r in np.unique(ratio):
        total += x[ratio == r].sum() / (np.maximum(x, y * r).sum() + only_a + only_b * r)
    return float(total)


def _held(texts: DataFrame) -> DataFrame:
    """node, sorted shingle hashes, and their weights where not all are 1."""

    def run(part: Texts, rows: pa.RecordBatch) -> pa.RecordBatch:
        found = _by_text(part)
        weights = [None if (w == 1).all() else w.astype("<u4").tobytes() for _, w in found]
        return arrow(
            ["node", "shingles", "weights"],
            [rows.column("node"), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array(weights, pa.binary())],
        )

    return map_texts(texts, run, "node binary, shingles binary, weights binary")


def _sets(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for h, w in zip(rows.column("shingles").to_pylist(), rows.column("weights").to_pylist(), strict=True):
        own = np.frombuffer(h, np.uint64)
        out.append((own, np.ones(len(own)) if w is None else np.frombuffer(w, "<u4").astype(np.float64)))
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``keys``, many groups at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        # All but the last group are whole.
        starts = _group_starts(now, keys)
        if len(starts) > 1:
            yield now.slice(0, int(starts[-1])).combine_chunks()
        rest = now.slice(int(starts[-1]))
    if rest is not None:
        yield rest.combine_chunks()


def _group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    new[0] = True
    for key in keys:
        column = rows.column(key).combine_chunks()
        new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def verified(pairs: DataFrame, held: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) whose texts reach the threshold.

    ``b`` is a pivot, which may have many pairs: they are dealt to blocks, and the pivot
    goes once to each of them.
    """
    spark = pairs.sparkSession
    prepare(spark)
    sized = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(sized, "b").select(
        "b", "a", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("pivot")
    )
    pivots = sized.select(
        "b", F.col("b").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("pivot")
    )
    rows = dealt.unionByName(pivots).join(held.withColumnRenamed("node", "a"), "a")
    rows = rows.repartition(shuffle_width(spark), "b", "block").sortWithinPartitions("b", "block", F.desc("pivot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["b", "block"]):
            starts = _group_starts(table, ["b", "block"])
            held_sets = _sets(table)
            near = np.zeros(len(table), bool)
            for i, j in zip(starts, [*starts[1:], len(table)], strict=True):
                if j > i + 1:  # the pivot comes first
                    near[i + 1 : j] = _near(held_sets[i], held_sets[i + 1 : j], threshold)
            yield from table.select(["a", "b"]).filter(pa.array(near)).to_batches()

    return rows.select("a", "b", "block", "pivot", "shingles", "weights").mapInArrow(run, "a binary, b binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Plain Jaccard of two arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _by_text(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    text, shingle, weight = weighted_shingles(texts)
    at = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    return [(shingle[i:j], weight[i:j]) for i, j in zip(at, at[1:], strict=False)]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), for all their ends.

    Large-star and small-star steps alternate until nothing moves; a hub's edges
    are never gathered in one place.
    """
    now = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
        )
        now = written(small.where("u != v").distinct(), "small")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _pivots(buckets: DataFrame, order: Column) -> DataFrame:
    """Pairs (a, b) of bucket members a with their bucket's pivot b of another class."""
    pivot = buckets.groupBy("bucket").agg(
        F.min_by(F.struct("node", "root"), order).alias("pivot"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
    )
    pivot = pivot.where("low != high").select(
        "bucket", F.col("pivot.node").alias("b"), F.col("pivot.root").alias("other")
    )
    # A document meets one pivot of each other class.
    met = buckets.join(pivot, "bucket").where("root != other").groupBy("node", "other")
    return (
        met.agg(F.min("b").alias("pivot"))
        .select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    )


def _mixed(placed: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes, with their bucket's largest class."""
    sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        sizes.groupBy("bucket")
        .agg(
            F.max_by("root", F.struct("n", "root")).alias("main"),
            F.max("n").alias("most"),
            F.sum("n").alias("n"),
        )
        .where("n > most")
        .select("bucket", "main")
    )
    return placed.join(mixed, "bucket")


def _linked_in_blocks(members: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join all classes of one bucket with a pair that reaches the threshold.

    Members outside the bucket's largest class are dealt to blocks on the left, all
    members to blocks on the right, and each pair of blocks is one group.
    """
    spark = members.sparkSession
    prepare(spark)
    few = F.col("root") != F.col("main")
    size = F.octet_length("shingles")
    deal = (
        members.join(held.select("node", size.alias("bytes")), "node")
        .groupBy("bucket")
        .agg(
            F.count(F.when(few, 1)).alias("n_left"),
            F.sum(F.when(few, F.col("bytes"))).alias("bytes_left"),
            F.count(F.lit(1)).alias("n"),
            F.sum("bytes").alias("bytes"),
        )
        .select(
            "bucket",
            F.ceil(F.greatest(F.col("n_left") / BLOCK, F.col("bytes_left") / BLOCK_BYTES)).cast("int").alias("lefts"),
            F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("rights"),
        )
    )
    members = members.join(deal, "bucket")
    # Salted, so that the two sides' blocks are dealt independently.
    left, right = F.xxhash64("node", F.lit("l")), F.xxhash64("node", F.lit("r"))
    first = members.where(few).select(
        "bucket", "node", "root", F.lit(True).alias("asks"), F.lit(False).alias("main"),
        F.pmod(left, F.col("lefts")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"),
    )
    second = members.select(
        "bucket", "node", "root", F.lit(False).alias("asks"), (~few).alias("main"),
        F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"),
        F.pmod(right, F.col("rights")).cast("int").alias("j"),
    )
    keys = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            a, b = _block_links(table, keys, threshold)
            node = table.column("node").combine_chunks()
            yield arrow(["a", "b"], [node.take(pa.array(a)), node.take(pa.array(b))])

    met = first.unionByName(second).join(held, "node")
    met = met.repartition(shuffle_width(spark), *keys).sortWithinPartitions(*keys, F.desc("asks"))
    return met.mapInArrow(run, "a binary, b binary")


def _block_links(table: pa.Table, keys: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table that are linked, one link for two classes that were apart."""
    starts = _group_starts(table, keys)
    ends = np.append(starts[1:], len(table))
    asks = table.column("asks").to_numpy()
    main = table.column("main").to_numpy()
    band = table.column("bucket").to_numpy() & (BANDS - 1)
    # Numbers in the order of the digests, which all blocks share.
    halves = np.frombuffer(b"".join(table.column("node").to_pylist()), ">u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    node = np.empty(len(table), np.int64)
    node[order] = np.cumsum(np.concatenate([[0], (halves[order[1:]] != halves[order[:-1]]).any(1)]))
    root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
    # The first and the last registers of each: by weight, and plain.
    found = table.column("registers").to_pylist()
    held, plain = (
        np.frombuffer(b"".join(r[part] for r in found), np.uint8).reshape(len(found), REGISTERS)
        for part in (slice(REGISTERS), slice(-REGISTERS, None))
    )
    repeats = np.array([len(r) > REGISTERS for r in found])
    size = np.array([len(h) for h in table.column("shingles").to_pylist()])
    n_asks = np.add.reduceat(asks.astype(np.int64), starts)
    middle = starts + n_asks
    label = np.arange(root.max(initial=-1) + 1)
    sets: list[tuple[np.ndarray, np.ndarray]] | None = None
    links: list[tuple[int, int]] = []
    for i, j in _pair_runs(starts, middle, ends):
        apart = (label[root[i]] != label[root[j]]) & (main[j] | (node[j] > node[i]))
        short, long = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        # Without repeats the similarity is at most the ratio of the numbers of shingles.
        apart &= repeats[i] | repeats[j] | (short >= threshold * long)
        i, j = i[apart], j[apart]
        same = held[i] == held[j]
        share = same.mean(1)
        either = repeats[i] | repeats[j]
        if either.any():
            share[either] = np.maximum(share[either], (plain[i[either]] == plain[j[either]]).mean(1))
        # A pair that shares an earlier band meets there.
        shared = same.reshape(-1, BANDS, ROWS).all(2)
        earlier = shared.any(1) & (shared.argmax(1) < band[i])
        close = np.flatnonzero((share >= threshold - SLACK) & ~earlier)
        if not len(close):
            continue
        sets = sets if sets is not None else _sets(table)
        i, j = i[close], j[close]
        heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        for lo, hi in zip(heads, [*heads[1:], len(i)], strict=True):
            mine, others = i[lo], j[lo:hi]
            others = others[label[root[others]] != label[root[mine]]]
            if not len(others):
                continue
            for k in others[_near(sets[mine], [sets[o] for o in others], threshold)]:
                p, q = label[root[mine]], label[root[k]]
                if p != q:
                    label[label == max(p, q)] = min(p, q)
                    links.append((mine, k))
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return a, b


def _pair_runs(starts: np.ndarray, middle: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (asking, other) rows of the groups, group after group, a bounded number at a time."""
    asking = np.concatenate([np.arange(a, b) for a, b in zip(starts, middle, strict=True)])
    group = np.repeat(np.arange(len(starts)), middle - starts)
    width = (ends - middle)[group]
    total = np.cumsum(width)
    at = 0
    while at < len(asking):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        own, n = asking[at:to], width[at:to]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(own, n), np.repeat(middle[group[at:to]], n) + within
        at = to


def _near(
    mine: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]], threshold: float
) -> np.ndarray:
    """Which of the others, none without shingles, reach the threshold by either measure."""
    size = np.array([len(o[0]) for o in others])
    flat = np.concatenate([o[0] for o in others])
    place = np.minimum(np.searchsorted(mine[0], flat), len(mine[0]) - 1)
    both = np.add.reduceat((mine[0][place] == flat).astype(np.int64), np.cumsum(size) - size)
    near = both / (len(mine[0]) + size - both) >= threshold
    # Without repeated shingles the two measures are one.
    repeats = (mine[1] != 1).any()
    for k in np.flatnonzero(~near):
        if repeats or (others[k][1] != 1).any():
            near[k] = probability_jaccard(mine, others[k]) >= threshold
    return near


def _rooted(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest), and of each distinct text (digest, doc_id, root).

    A text's node is its digest; ``doc_id`` is its smallest, ``root`` names its class.
    """
    rows = written(sketches(docs), "sketches")
    # min() passes over nulls: only a text without any id keeps a null one.
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    copies = written(copies.withColumn("node", F.unhex("digest")), "copies")

    def standing(table: DataFrame, of: DataFrame) -> DataFrame:
        """The rows of one document of each distinct text; it stands for the text."""
        of = of.select("node", F.col("digest").alias("own"), F.col("doc_id").alias("least"))
        same = (table["digest"] == of["own"]) & table["doc_id"].eqNullSafe(of["least"])
        return table.join(of, same).dropDuplicates(["node"])

    members = standing(rows, copies).select("node", "registers", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    buckets = written(members.join(shared, "bucket").select("bucket", "node"), "buckets")

    wanted = copies.join(buckets.select("node").distinct(), "node")
    source = docs.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    held = _held(standing(source, wanted).select("node", "text"))
    held = written(held.join(standing(rows, wanted).select("node", "registers"), "node"), "held")
    links = roots = None
    for turn in range(PIVOT_ROUNDS + 1):
        placed = buckets.withColumn("root", F.col("node"))
        if roots is not None:
            placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn < PIVOT_ROUNDS:
            order = F.col("node") if turn == 0 else F.xxhash64("node", "bucket", F.lit(turn))
            pairs = _pivots(placed, order)
            if turn == 0:  # one pivot for each document, the smallest over its buckets
                pairs = pairs.groupBy("a").agg(F.min("b").alias("b"))
            found = verified(written(pairs, "pairs"), held, threshold)
        else:
            found = _linked_in_blocks(_mixed(written(placed, "placed")), held, threshold)
        found = written(found, "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = written(components(links), "roots")
    if roots is not None:
        copies = copies.join(roots, "node", "left")
    else:
        copies = copies.withColumn("root", F.lit(None).cast("binary"))
    named = copies.select("digest", "doc_id", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "digest"), named


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, digest of its text and class_id."""
    rows, named = _rooted(docs, threshold)
    ids = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = named.select("digest", "root").join(ids, "root").select("digest", "class_id")
    return rows.join(named, "digest").select("doc_id", "digest", "class_id")


def first_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document with the smallest id of each class, all columns as they were."""
    _, named = _rooted(docs, threshold)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    kept = named.groupBy("root").agg(F.min(first).alias("first")).select("first.doc_id", "first.digest")
    kept = written(kept.withColumnRenamed("doc_id", "class_id"), "kept")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = keyed.select(
        "row", F.col("row.doc_id").alias("class_id"), digest(F.col("row.text")).alias("digest")
    )
    same = keyed["class_id"].eqNullSafe(kept["class_id"]) & (keyed["digest"] == kept["digest"])
    rows = keyed.join(kept, same, "left_semi")
    return rows.dropDuplicates(["class_id", "digest"]).select("row.*")
