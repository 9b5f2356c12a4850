"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

A text is lower-cased in A-Z and cut into words between white space; its shingles are
four consecutive words joined by one space (all words of a shorter text), repeats
included. A shingle's hash is XXH64 with seed 42 of its UTF-8 bytes, and a bit of the
fingerprint is 1 where it is set in over half of the hashes. Two texts are linked when
their fingerprints differ in at most ``BUDGET`` bits; classes are what links reach.

The distinct fingerprints form a binary trie. Pairs of trie nodes are walked down
together from the pair of roots: each step takes the children of both sides, adds the
bits in which they differ, and drops the pair as soon as the sum exceeds the budget. By
the pigeonhole principle some third of the 64 bits holds at most one of four differing
bits, so there are three tries, one with each third in front, and within its front third
a pair may spend one bit only; that bounds the pairs where tries are full.

The upper part of the walk is DataFrame joins of node pairs with their children,
``STRIDE`` levels at a time. A node is a leaf there as soon as it holds at most ``LEAF``
fingerprints, however deep it lies, so a crowded prefix is split further and no leaf is
large. Each pair of leaves that survives is one row with both sides' sorted fingerprints,
and a task walks the rest of the way down in numpy, level by level. It hands on only a
spanning forest of the links it finds, fewer rows than fingerprints on both sides. Classes
come from large-star and small-star steps over these links; every link that is not handed
on joins fingerprints of one class.

Defined results: null counts as the empty text; a text without words has fingerprint 0,
which is linked like any other; repeated rows and equal texts share a fingerprint; an
empty table gives an empty result. ``component_id`` is the smallest document id of the
class; rows without an id take part and get one, null only if no document of the class has
an id. A very long text is worked through in runs of words of bounded number. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width
from .common import arrow, map_texts, prepare, written
from .neardup import components
from .textops import LOWER, Texts, words

WIDTH = 4
SEED = 42
BITS = 64
BUDGET = 4
#: Tries, each with another part of the fingerprint in front.
TURNS = 3
#: Fingerprints of a leaf of the upper trie, and levels per step there.
LEAF = 4096
STRIDE = 4
#: Words whose shingles are hashed at a time.
RUN = 1 << 17
#: Bytes beyond which a shingle is hashed by itself.
LONG = 1024
#: Pairs of fingerprints compared at a time, and pairs that are not worth another level.
PAIRS = 1 << 20
FEW = 64

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(11400714785074694791),
    np.uint64(14029467366897019727),
    np.uint64(1609587929392839161),
    np.uint64(9650029242287828579),
    np.uint64(2870177450012600261),
)


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges of ``data`` at once."""
    size = len(data)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((size + 1,), "<u8", buffer=data, strides=(1,))
    four = np.ndarray((size + 1,), "<u4", buffer=data, strides=(1,))
    at, rest = start.copy(), length.copy()
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        out = np.full(len(start), s + P5, np.uint64)
        wide = np.flatnonzero((length >= 32) & (length <= LONG))
        if len(wide):
            lanes = [np.full(len(wide), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            stripes = length[wide] // 32
            order = np.argsort(-stripes, kind="stable")
            wide, stripes = wide[order], stripes[order]
            for k in range(int(stripes[0])):
                n = int(np.searchsorted(-stripes, -k, "left"))  # those with more than k stripes
                place = start[wide[:n]] + 32 * k
                for v, lane in enumerate(lanes):
                    lane[:n] = _round(lane[:n], eight[place + 8 * v])
            h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                h = (h ^ _round(np.zeros(len(wide), np.uint64), lane)) * P1 + P4
            out[wide] = h
            at[wide] += 32 * stripes
            rest[wide] -= 32 * stripes
        out += length.astype(np.uint64)
        rest[length > LONG] = 0
        while len(own := np.flatnonzero(rest >= 8)):
            lane = _round(np.zeros(len(own), np.uint64), eight[at[own]])
            out[own] = _rotl(out[own] ^ lane, 27) * P1 + P4
            at[own] += 8
            rest[own] -= 8
        own = np.flatnonzero(rest >= 4)
        out[own] = _rotl(out[own] ^ (four[at[own]].astype(np.uint64) * P1), 23) * P2 + P3
        at[own] += 4
        rest[own] -= 4
        while len(own := np.flatnonzero(rest >= 1)):
            out[own] = _rotl(out[own] ^ (data[at[own]].astype(np.uint64) * P5), 11) * P1
            at[own] += 1
            rest[own] -= 1
        out = (out ^ (out >> np.uint64(33))) * P2
        out = (out ^ (out >> np.uint64(29))) * P3
        out ^= out >> np.uint64(32)
    for i in np.flatnonzero(length > LONG):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]].tobytes(), seed)
    return out


def fingerprints_of(texts: Texts) -> np.ndarray:
    """Fingerprint of each text; 0 without words."""
    found = words(texts)
    n = np.diff(found.of)
    ones = np.zeros((len(texts), BITS), np.int64)
    total = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    of_word = found.text()
    for low in range(0, len(found.start), RUN):
        high = min(low + RUN, len(found.start))
        last = min(high + WIDTH - 1, len(found.start))
        start, end = found.start[low:last], found.end[low:last]
        size = end - start
        # The words again, lower-cased and one space apart.
        place = np.cumsum(size + 1) - (size + 1)
        room = np.full(int(size.sum()) + len(size), 32, np.uint8)
        within = np.repeat(np.arange(len(size)), size)
        source = np.arange(len(within)) + np.repeat(start - (np.cumsum(size) - size), size)
        room[np.arange(len(within)) + within] = LOWER[texts.data[source]]
        text = of_word[low:high]
        first = np.arange(low, high)
        begins = np.flatnonzero(first - found.of[text] < total[text])
        text = text[begins]
        to = begins + np.minimum(n[text], WIDTH) - 1
        hashes = xxh64(room, place[begins], place[to] + size[to] - place[begins])
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        ones[text[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a long) of every text."""

    def run(texts: Texts, rows: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprints_of(texts).view(np.int64)
        return arrow(["doc_id", "fingerprint"], [rows.column("doc_id"), found])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, fingerprint long")


def _offsets(turns: int) -> list[int]:
    """First bit of each part, counted from the front; the last entry is the end."""
    return [BITS * t // turns for t in range(turns + 1)]


def _turned(fp: Column, by: int) -> Column:
    """The fingerprint with bit ``by`` in front."""
    if by == 0:
        return fp
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _front(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits, the rest zero."""
    return F.lit(0).cast("long") if depth == 0 else key.bitwiseAND(F.lit(-(1 << (BITS - depth))))


def _leaves(keys: DataFrame, leaf: int, stride: int) -> tuple[list[DataFrame], DataFrame]:
    """The upper trie: nodes of each level (turn, low, leaf), and the leaves' sorted keys.

    ``low`` is a node's prefix followed by zeros. Keys leave the loop with the first node
    on their way that holds few enough.
    """
    levels, contents = [], None
    active, depth = keys, 0
    while True:
        placed = active.withColumn("low", _front(F.col("key"), depth))
        nodes = placed.groupBy("turn", "low").agg(F.count(F.lit(1)).alias("n"))
        nodes = written(nodes.select("turn", "low", (F.col("n") <= leaf).alias("leaf")), "trie")
        levels.append(nodes)
        placed = placed.join(nodes, ["turn", "low"])
        done = placed.where("leaf").groupBy("turn", "low").agg(F.array_sort(F.collect_list("key")).alias("keys"))
        done = done.withColumn("depth", F.lit(depth))
        contents = done if contents is None else contents.unionByName(done)
        if nodes.where("not leaf").isEmpty():
            return levels, written(contents, "leaves")
        active = written(placed.where("not leaf").select("turn", "key"), "crowded")
        depth += stride


def _leaf_pairs(levels: list[DataFrame], turns: int, budget: int, stride: int) -> DataFrame:
    """Pairs of leaves whose prefixes stay within the budget: turn, a, depth_a, b, depth_b."""
    parts = _offsets(turns)
    front = F.element_at(F.array(*[F.lit(j - i) for i, j in zip(parts, parts[1:], strict=False)]), F.col("turn") + 1)
    root = levels[0].select(
        "turn", F.col("low").alias("a"), F.lit(0).alias("depth_a"), F.col("leaf").alias("leaf_a"),
        F.col("low").alias("b"), F.lit(0).alias("depth_b"), F.col("leaf").alias("leaf_b"),
    )
    done, open_ = root.where("leaf_a and leaf_b"), root.where("not (leaf_a and leaf_b)")
    kept = [done]
    waiting = None  # leaves of levels above, which stay as they are
    for level in range(1, len(levels)):
        depth = level * stride
        children = levels[level].select(
            "turn", _front(F.col("low"), depth - stride).alias("up"), F.lit(depth - stride).alias("up_depth"),
            "low", F.lit(depth).alias("depth"), "leaf",
        )
        ended = levels[level - 1].where("leaf").select(
            "turn", F.col("low").alias("up"), F.lit(depth - stride).alias("up_depth"), "low",
            F.lit(depth - stride).alias("depth"), "leaf",
        )
        waiting = ended if waiting is None else waiting.unionByName(ended)
        below = children.unionByName(waiting)
        pairs = open_.drop("leaf_a", "leaf_b")
        for side in "ab":
            step = below.select(
                "turn", F.col("up").alias(side), F.col("up_depth").alias(f"depth_{side}"),
                F.col("low").alias("to"), F.col("depth").alias("to_depth"), F.col("leaf").alias(f"leaf_{side}"),
            )
            pairs = pairs.join(step, ["turn", side, f"depth_{side}"]).drop(side, f"depth_{side}")
            pairs = pairs.withColumnsRenamed({"to": side, "to_depth": f"depth_{side}"})
        common = F.least("depth_a", "depth_b")
        differ = F.col("a").bitwiseXOR(F.col("b"))
        shown = lambda n: F.when(n == 0, 0).otherwise(F.bit_count(F.expr("shiftrightunsigned(x, 64 - n)")))
        pairs = (
            pairs.withColumn("x", differ)
            .withColumn("n", common)
            .withColumn("total", shown(F.col("n")))
            .withColumn("n", F.least(common, front))
            .withColumn("lead", shown(F.col("n")))
            .where((F.col("total") <= budget) & (F.col("lead") <= budget // turns))
        )
        # Unordered: of a node and its own copy, each pair of children once.
        sign = F.lit(-(1 << 63))
        pairs = pairs.where(F.col("a").bitwiseXOR(sign) <= F.col("b").bitwiseXOR(sign)).drop("x", "n", "total", "lead")
        pairs = written(pairs, "node_pairs")
        kept.append(pairs.where("leaf_a and leaf_b"))
        open_ = pairs.where("not (leaf_a and leaf_b)")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.drop("leaf_a", "leaf_b")


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j; a class is labelled by its smallest member."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _expand(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of the ranges lo..hi times lo2..hi2."""
    width = hi2 - lo2
    n = (hi - lo) * width
    of = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return lo[of] + within // width[of], lo2[of] + within % width[of]


def trie_links(
    x: np.ndarray, y: np.ndarray, depth: int, front: int, lead: int, budget: int, same: bool
) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sorted arrays of fingerprints.

    Both sides share no more than their first ``depth`` bits each. Returns positions in
    the two arrays one after the other; with ``same`` the arrays are one and the same.
    """
    both = x if same else np.concatenate([x, y])
    shift = 0 if same else len(x)
    label = np.arange(len(both))
    a_lo, a_hi = np.array([0]), np.array([len(x)])
    b_lo, b_hi = np.array([0]), np.array([len(y)])
    differ = x[:1] ^ y[:1]
    spent = np.bitwise_count(differ >> np.uint64(BITS - depth) if depth else differ * np.uint64(0)).astype(np.int64)
    while len(a_lo):
        n = (a_hi - a_lo) * (b_hi - b_lo)
        flat = np.flatnonzero((n <= FEW) | (depth == BITS))
        at = 0
        while at < len(flat):
            ahead = np.cumsum(n[flat[at:]])
            to = at + max(1, int(np.searchsorted(ahead, PAIRS, "right")))
            part = flat[at:to]
            i, j = _expand(a_lo[part], a_hi[part], b_lo[part], b_hi[part])
            j = j + shift
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            near = np.bitwise_count(both[i] ^ both[j]) <= budget
            _merge(label, i[near], j[near])
            at = to
        more = np.flatnonzero((n > FEW) & (depth < BITS))
        if not len(more):
            break
        a_lo, a_hi, b_lo, b_hi, spent = a_lo[more], a_hi[more], b_lo[more], b_hi[more], spent[more]
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        above = ~np.uint64(0) << np.uint64(BITS - depth) if depth else np.uint64(0)
        a_mid = np.clip(np.searchsorted(x, (x[a_lo] & above) | bit), a_lo, a_hi)
        b_mid = np.clip(np.searchsorted(y, (y[b_lo] & above) | bit), b_lo, b_hi)
        own = same & (a_lo == b_lo) & (a_hi == b_hi)
        depth += 1
        limit = min(lead, budget) if depth <= front else budget
        sides = []
        for al, ah, bl, bh, add, keep in (
            (a_lo, a_mid, b_lo, b_mid, 0, None),
            (a_mid, a_hi, b_mid, b_hi, 0, None),
            (a_lo, a_mid, b_mid, b_hi, 1, None),
            (a_mid, a_hi, b_lo, b_mid, 1, ~own),
        ):
            stay = (ah > al) & (bh > bl) & (spent + add <= limit)
            if keep is not None:
                stay &= keep
            sides.append([v[stay] for v in (al, ah, bl, bh, spent + add)])
        a_lo, a_hi, b_lo, b_hi, spent = (np.concatenate(v) for v in zip(*sides, strict=True))
    i = np.flatnonzero(label != np.arange(len(both)))
    return i, label[i]


def links(
    keys: DataFrame, budget: int = BUDGET, turns: int = TURNS, leaf: int = LEAF, stride: int = STRIDE
) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``keys`` (distinct, not null) within the budget.

    Of the links inside a pair of leaves only a spanning forest is returned.
    """
    if BITS % stride or leaf < 1:
        raise ValueError("the stride must divide 64 and a leaf hold at least one fingerprint")
    prepare(keys.sparkSession)
    parts = _offsets(turns)
    turned = keys.select(
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("turn"), _turned(F.col("fingerprint"), parts[t]).alias("key")) for t in range(turns)])
        ).alias("t")
    ).select("t.*")
    levels, contents = _leaves(turned, leaf, stride)
    pairs = _leaf_pairs(levels, turns, budget, stride)
    for side in "ab":
        held = contents.select(
            "turn", F.col("low").alias(side), F.col("depth").alias(f"depth_{side}"), F.col("keys").alias(f"keys_{side}")
        )
        pairs = pairs.join(held, ["turn", side, f"depth_{side}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for turn, a, depth_a, b, depth_b, x, y in zip(
                *[batch.column(c).to_pylist() for c in ("turn", "a", "depth_a", "b", "depth_b")],
                *[batch.column(c) for c in ("keys_a", "keys_b")],
                strict=True,
            ):
                # Sorted as signed numbers by Spark; here the front bit is the highest.
                x = np.sort(x.values.to_numpy(zero_copy_only=False).view(np.uint64))
                y = np.sort(y.values.to_numpy(zero_copy_only=False).view(np.uint64))
                same = (a, depth_a) == (b, depth_b)
                i, j = trie_links(
                    x, y, min(depth_a, depth_b), parts[turn + 1] - parts[turn], budget // turns, budget, same
                )
                both = x if same else np.concatenate([x, y])
                back = [both[k] if not parts[turn] else _rotl(both[k], BITS - parts[turn]) for k in (i, j)]
                yield arrow(["a", "b"], [v.view(np.int64) for v in back])

    # Dealt by number: a pair's work does not follow from its bytes.
    dealt = pairs.repartition(shuffle_width(keys.sparkSession))
    return dealt.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id."""
    rows = written(fingerprints(docs), "fingerprints")
    copies = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "copies")
    found = written(links(copies.select("fingerprint"), budget, leaf=leaf), "links")
    named = copies.withColumn("root", F.col("fingerprint"))
    if not found.isEmpty():
        roots = written(components(found), "roots").withColumnRenamed("node", "fingerprint")
        named = copies.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fingerprint", "root").join(least, "root").drop("root")
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fingerprint").select("doc_id", shown, "component_id")
