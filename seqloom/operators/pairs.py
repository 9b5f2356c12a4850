"""Pairwise diagnostics: sequence identity and cosine similarity.

The all-pairs distributions compare blocks of rows with blocks of rows. Rows
are hashed into blocks of bounded size, every pair of blocks is one small
group, and a task returns only bin counts or the pairs over a threshold, never
the full pair table. The cost is quadratic by definition; ``near_identical_join``
finds the similar pairs of a large table through shared k-mers instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HISTOGRAM_BINS
from ..functions.kmers import kmer_codes
from ..functions.lcs import (
    indel_ratio,
    lcs_at_least,
    lcs_length,
    letter_masks,
)
from ..functions.ragged import offsets_of
from ..session import cut_lineage, ship_package, shuffle_width

SIDES = ("train", "test")
SETS = ("train_train", "test_test", "train_test")


def block_cells(df: DataFrame, key: Column, block_rows: int) -> DataFrame:
    """Copy each row into the cells (bi, bj), bi <= bj, that its block takes part in.

    Keys are distinct, so hashing gives even blocks however the data is skewed. The
    rows are written once: they are counted first and then read for every block.
    """
    ship_package(df.sparkSession)
    rows = cut_lineage(df)
    blocks = max(1, ceil(rows.count() / block_rows))
    placed = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    return placed.select("*", F.explode(others).alias("_o")).select(
        *placed.columns,
        F.least("_b", "_o").alias("_bi"),
        F.greatest("_b", "_o").alias("_bj"),
    )


def _cell_sides(frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    bi, bj = frame["_bi"].iat[0], frame["_bj"].iat[0]
    if bi == bj:
        return frame, frame, True
    return frame[frame["_b"] == bi], frame[frame["_b"] == bj], False


def pair_set(a: str, b: str) -> str:
    return f"{a}_{b}" if a == b else "train_test"


# -- sequence identity ---------------------------------------------------------


def _sided_sequences(df: DataFrame, split: str) -> DataFrame:
    """Distinct (side, sequence); sequence identity looks at train and test only."""
    return (
        df.where(F.col(split).isin(*SIDES))
        .select(F.col(split).alias("side"), "sequence")
        .distinct()
    )


def _identity_cells(df: DataFrame, split: str, block_rows: int) -> DataFrame:
    rows = _sided_sequences(df, split)
    return block_cells(rows, F.concat_ws("|", "side", "sequence"), block_rows)


def _identity_in_cell(frame: pd.DataFrame) -> Iterator[tuple[str, str, str, str, float]]:
    left, right, same = _cell_sides(frame)
    rows = list(zip(right["side"], right["sequence"]))
    for i, (side_a, a) in enumerate(zip(left["side"], left["sequence"])):
        masks = letter_masks(a)
        for side_b, b in rows[i:] if same else rows:
            lcs = len(a) if a == b else lcs_length(masks, len(a), b)
            yield side_a, a, side_b, b, indel_ratio(lcs, len(a), len(b))


def sequence_identity_histogram(
    df: DataFrame,
    split: str = "data_split",
    bins: int = HISTOGRAM_BINS,
    block_rows: int = 64,
) -> DataFrame:
    """(pair_set, bin, n) of ``2 * LCS / (la + lb)`` over all pairs of distinct sequences.

    Within a split each pair counts once, a sequence also with itself, and a
    ratio of 0 is left out; between the splits every pair counts.
    """

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        tally = np.zeros((len(SETS), bins), dtype=np.int64)
        for side_a, _, side_b, _, ratio in _identity_in_cell(frame):
            if ratio > 0.0 or side_a != side_b:
                name = pair_set(side_a, side_b)
                tally[SETS.index(name), min(int(ratio * bins), bins - 1)] += 1
        s, b = np.nonzero(tally)
        return pd.DataFrame({"pair_set": [SETS[i] for i in s], "bin": b, "n": tally[s, b]})

    cells = _identity_cells(df, split, block_rows)
    partial = cells.groupBy("_bi", "_bj").applyInPandas(count, "pair_set string, bin int, n long")
    return partial.groupBy("pair_set", "bin").agg(F.sum("n").alias("n"))


def sequence_identity_pairs(
    df: DataFrame, min_ratio: float, split: str = "data_split", block_rows: int = 64
) -> DataFrame:
    """(pair_set, sequence_a, sequence_b, ratio) of the pairs with at least ``min_ratio``.

    Exact at any threshold over 0. Train-test pairs list the training side first.
    """
    if min_ratio <= 0.0:
        raise ValueError("min_ratio must be over 0; the histogram covers the whole range")

    def list_pairs(frame: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for side_a, a, side_b, b, ratio in _identity_in_cell(frame):
            if ratio >= min_ratio:
                if (side_a, side_b) == ("test", "train") or (side_a == side_b and b < a):
                    a, b = b, a
                kept.append((pair_set(side_a, side_b), a, b, ratio))
        return pd.DataFrame(kept, columns=["pair_set", "sequence_a", "sequence_b", "ratio"])

    return _identity_cells(df, split, block_rows).groupBy("_bi", "_bj").applyInPandas(
        list_pairs, "pair_set string, sequence_a string, sequence_b string, ratio double"
    )


# -- near-identical join -------------------------------------------------------


#: Longest segment tried.
WIDEST = 32
#: Letters of a block, each row counted as some more; letters tokenized and matches held at a time.
BLOCK_LETTERS = 8 << 20
ROW_LETTERS = 64
SLICE_LETTERS = 1 << 17
MATCHES = 2 << 20
#: A token is looked up by its leading bits, some more than number the tokens, up to so many.
LEADING_BITS = 24
#: Classes that letters and neighbouring letters are counted by, and pairs compared at a time.
CLASSES = {1: 32, 2: 256}
PAIRS = 1 << 13


def edit_budget(length: np.ndarray, threshold: float) -> np.ndarray:
    """Most letters left unmatched, on both sides, by a sequence and a partner that is not shorter.

    la + lb - 2 * LCS <= (1 - t)(la + lb), and la + lb <= 2 * la / t.
    """
    return np.floor(2 * length * (1 - threshold) / threshold + 1e-9).astype(np.int64)


def segment_widths(length: np.ndarray, threshold: float) -> np.ndarray:
    """Letters per segment, so that more segments than the edit budget fit; 0 if none do.

    The widest that leave one segment in 200 letters more than the least: a longer segment
    is rarer, and several have to match.
    """
    spare = edit_budget(length, threshold) + 1 + length // 200
    out = np.zeros(len(length), np.int64)
    for k in range(1, WIDEST + 1):
        out[length // k >= spare] = k
    return out


def near_identical_join(
    df: DataFrame, threshold: float = 0.95, key: str = "seq_id"
) -> DataFrame:
    """(id_a, id_b, ratio) of distinct sequences at least ``threshold`` alike.

    Exact, by the pigeonhole principle: an unmatched letter spoils at most one of a
    sequence's disjoint segments, so with more segments than unmatched letters some stand
    whole in the partner, and none is shifted by more letters than are unmatched. The
    shorter sequence of a pair is cut into segments, the longer one offers all its k-mers
    with their positions, and the two meet by equal letters in buckets of like lengths. A
    pair goes on if as many segments are met as must be; the exact ratio decides. Copies are
    folded first, each distinct sequence is represented by its smallest id.

    Tokens never leave a task: sequences are packed into blocks of one bucket, blocks of the
    same and of neighbouring buckets are read for each pair, and segments met are counted
    there. What is shuffled and written grows with the letters alone.
    """
    if not 0.5 < threshold < 1.0:
        raise ValueError("threshold must be in (0.5, 1); copies are found by a plain distinct")
    far = np.arange(1, 20_000)
    if (segment_widths(far, threshold)[edit_budget(far, threshold) > 0] == 0).any():
        raise ValueError(f"no segment length can promise a match at {threshold}")
    spark = df.sparkSession
    ship_package(spark)
    kind = df.schema[key].dataType.simpleString()
    blocks = _sequence_blocks(df, threshold, key)
    sides = [blocks.select(F.struct(*blocks.columns).alias(s)) for s in ("a", "b")]
    # The shorter sequence of a pair lies in the longer one's bucket or in the one below.
    step = F.col("b.bucket") - F.col("a.bucket")
    cells = sides[0].crossJoin(sides[1]).where((step >= 0) & (step <= 1))
    if int(spark.conf.get(_ARROW_BYTES).rstrip("bB")) > BLOCK_LETTERS:
        spark.conf.set(_ARROW_BYTES, str(BLOCK_LETTERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, left = None, None
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                # Pairs of one left block follow each other.
                if place != (a["bucket"].as_py(), a["block"].as_py()):
                    place = (a["bucket"].as_py(), a["block"].as_py())
                    left = None  # before the next one takes its memory
                    left = _SegmentIndex(a["ids"].as_py(), a["sequences"].as_py(), threshold)
                if left.widths:
                    found = list(left.partners(b["ids"].as_py(), b["sequences"].as_py()))
                    ids, ratios = a["ids"].values.type, pa.float64()
                    columns = list(zip(*found)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (ids, ids, ratios))],
                        ["id_a", "id_b", "ratio"],
                    )

    return cells.mapInArrow(run, f"id_a {kind}, id_b {kind}, ratio double")


def _sequence_blocks(df: DataFrame, threshold: float, key: str) -> DataFrame:
    """One row per block: bucket of lengths, number, ids and sequences; copies are folded.

    Lengths of a pair differ by less than a bucket's growth, so they lie in the same or in
    neighbouring buckets. Sequences are distinct, so their hash deals them evenly however
    the ids or the texts are skewed. An empty sequence has no near copies.
    """
    growth = log(1.0001 * (2 - threshold) / threshold)
    bucket = F.floor(F.log(F.length("sequence").cast("double")) / F.lit(growth)).cast("int")
    distinct = df.groupBy("sequence").agg(F.min(key).alias("id"))
    distinct = distinct.where((F.length("sequence") > 0) & F.col("id").isNotNull())
    distinct = cut_lineage(distinct.withColumn("bucket", bucket), "distinct")
    kind = distinct.schema["id"].dataType.simpleString()
    size = F.sum(F.length("sequence").cast("long") + ROW_LETTERS)
    dealt = distinct.groupBy("bucket").agg(F.ceil(size / BLOCK_LETTERS).cast("long").alias("_blocks"))
    placed = distinct.join(F.broadcast(dealt), "bucket").withColumn(
        "block", F.pmod(F.xxhash64("sequence"), "_blocks").cast("int")
    )

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ends = pa.array([0, len(rows)], pa.int32())
        lists = [
            pa.ListArray.from_arrays(ends, rows.column(c).combine_chunks()) for c in ("id", "sequence")
        ]
        return pa.table([rows.column("bucket")[:1], rows.column("block")[:1], *lists], names)

    names = ["bucket", "block", "ids", "sequences"]
    schema = f"bucket int, block int, ids array<{kind}>, sequences array<string>"
    width = shuffle_width(df.sparkSession)
    packed = placed.repartition(width, "bucket", "block").groupBy("bucket", "block").applyInArrow(pack, schema)
    return cut_lineage(packed, "blocks")


def _letter_slices(sequences: list[str], lengths: np.ndarray) -> Iterator[slice]:
    """Runs of sequences of about ``SLICE_LETTERS`` letters."""
    at = (np.cumsum(lengths) - lengths) // SLICE_LETTERS
    bounds = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sequences)]
    yield from (slice(i, j) for i, j in zip(bounds, bounds[1:]) if i < j)


def _ragged_range(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. below each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass
class _Segments:
    """The segments of one width: distinct tokens, where their owners and places begin, and
    the first token for each value of the leading bits."""

    tokens: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    places: np.ndarray
    bits: int
    firsts: np.ndarray

    @classmethod
    def of(cls, tokens: np.ndarray, owners: np.ndarray, places: np.ndarray) -> _Segments:
        order = np.argsort(tokens, kind="stable")
        distinct, starts = np.unique(tokens[order], return_index=True)
        bits = min(LEADING_BITS, len(distinct).bit_length() + 1)
        firsts = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(_leading(distinct, bits), minlength=1 << bits), out=firsts[1:])
        ends = np.append(starts, len(tokens)).astype(np.int32)
        return cls(distinct, ends, owners[order], places[order], bits, firsts)

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``codes``, place in ``tokens``) of every code that is a token."""
        lead = _leading(codes, self.bits)
        slot, last = self.firsts[lead], self.firsts[lead + 1]
        at = np.flatnonzero(slot < last)
        slot, last, code = slot[at], last[at], codes[at]
        places, slots = [], []
        # Few tokens share their leading bits, so this ends after a few rounds.
        while len(at):
            same = self.tokens[slot] == code
            places.append(at[same])
            slots.append(slot[same])
            more = ~same & (slot + 1 < last)
            at, slot, last, code = at[more], slot[more] + 1, last[more], code[more]
        return np.concatenate([np.empty(0, np.int64), *places]), np.concatenate([np.empty(0, np.int32), *slots])


class _SegmentIndex:
    """The disjoint segments of a block's sequences by their letters, for each width in use."""

    def __init__(self, ids: list, sequences: list[str], threshold: float) -> None:
        self.ids, self.sequences, self.threshold = ids, sequences, threshold
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        budget = edit_budget(self.lengths, threshold)
        width = np.where(budget > 0, segment_widths(self.lengths, threshold), 0)
        self.need = self.lengths // np.maximum(width, 1) - budget
        self.widths = {}
        for k in np.unique(width[width > 0]).tolist():
            self.widths[k] = self._segments(np.flatnonzero(width == k), k)
        self.counts = {n: _class_counts(sequences, self.lengths, n) for n in CLASSES}

    def _segments(self, chosen: np.ndarray, k: int) -> _Segments:
        tokens, owners, places = [], [], []
        own = [self.sequences[i] for i in chosen.tolist()]
        for part in _letter_slices(own, self.lengths[chosen]):
            lengths = self.lengths[chosen[part]]
            segments = lengths // k
            place = _ragged_range(segments) * k
            codes = kmer_codes("".join(own[part]), k).view(np.uint64)
            tokens.append(codes[np.repeat(np.cumsum(lengths) - lengths, segments) + place])
            owners.append(np.repeat(chosen[part], segments).astype(np.int32))
            places.append(place.astype(np.int32))
        return _Segments.of(*(np.concatenate(x) for x in (tokens, owners, places)))

    def partners(self, ids: list, sequences: list[str]) -> Iterator[tuple]:
        """(id_a, id_b, ratio) of the block's sequences and those given, none shorter."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        for part in _letter_slices(sequences, lengths):
            a, b = self._candidates(sequences[part], lengths[part])
            for i, j in zip(a.tolist(), (b + part.start).tolist()):
                mine, other = (self.ids[i], self.sequences[i]), (ids[j], sequences[j])
                # Sequences of one length meet in both orders; one counts.
                if len(mine[1]) == len(other[1]) and mine >= other:
                    continue
                ratio = _ratio_at_least(mine[1], other[1], self.threshold)
                if ratio is not None:
                    yield min(mine[0], other[0]), max(mine[0], other[0]), ratio

    def _candidates(self, sequences: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (own, given) of which as many segments are met as must be, and with letters
        and neighbouring letters enough in common.

        A segment met twice counts twice, which only lets more pairs through.
        """
        text, starts = "".join(sequences), np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        pairs, hits = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, segments in self.widths.items():
            at, token = segments.look_up(kmer_codes(text, k).view(np.uint64))
            b = of[at]
            place = at - starts[b]
            within = place <= lengths[b] - k
            b, place, token = b[within], place[within], token[within]
            first = segments.starts[token]
            met = segments.starts[token + 1] - first
            group = np.cumsum(met, dtype=np.int64) // MATCHES
            bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(met)]
            for i, j in zip(bounds, bounds[1:]):
                n = met[i:j]
                there = np.repeat(first[i:j], n) + _ragged_range(n)
                mine, other = segments.owners[there], np.repeat(b[i:j], n)
                la, lb = self.lengths[mine], lengths[other]
                shift = np.abs(segments.places[there] - np.repeat(place[i:j], n))
                total = la + lb
                like = (la <= lb) & (shift <= (1 - self.threshold) * total + 1e-9)
                like &= 2.0 * la >= (self.threshold - 1e-12) * total
                found, count = np.unique(
                    other[like].astype(np.int64) * len(self.ids) + mine[like], return_counts=True
                )
                pairs.append(found)
                hits.append(count)
        found, at = np.unique(np.concatenate(pairs), return_inverse=True)
        count = np.zeros(len(found), np.int64)
        np.add.at(count, at, np.concatenate(hits))
        b, a = np.divmod(found, len(self.ids))
        enough = count >= self.need[a]
        return self._with_common_classes(a[enough], b[enough], sequences, lengths)

    def _with_common_classes(
        self, a: np.ndarray, b: np.ndarray, sequences: list[str], lengths: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Without pairs that have too few letters, or neighbouring letters, in common.

        All of a class count as equal, so no pair is lost. Of the neighbours of one sequence,
        each of its unmatched letters parts two, each unmatched one of the other at most one.
        """
        for n in CLASSES if len(a) else ():
            total = self.lengths[a] + lengths[b]
            need = _least_common(total, self.threshold)
            if n == 2:
                need = 3 * need - total - 1
            theirs = _class_counts(sequences, lengths, n)
            kept = np.ones(len(a), bool)
            for at in range(0, len(a), PAIRS):
                some = slice(at, at + PAIRS)
                common = np.minimum(self.counts[n][a[some]], theirs[b[some]]).sum(axis=1, dtype=np.int64)
                kept[some] = common >= need[some]
            a, b = a[kept], b[kept]
        return a, b


def _class_counts(sequences: list[str], lengths: np.ndarray, n: int) -> np.ndarray:
    """(sequences, classes): how many letters, or runs of ``n`` of them, there are of each class."""
    classes = CLASSES[n]
    counts = np.zeros((len(sequences), classes), np.int16 if lengths.max(initial=0) < 1 << 15 else np.int32)
    for part in _letter_slices(sequences, lengths):
        letters = np.frombuffer("".join(sequences[part]).encode("utf-32-le"), np.uint32)
        code = letters[: len(letters) - n + 1].copy()
        for i in range(1, n):
            code = code * 37 + letters[i : len(letters) - n + 1 + i]
        own = lengths[part]
        row = np.repeat(np.arange(len(own)), own)[: len(code)]
        inside = np.arange(len(code)) + n <= np.cumsum(own)[row]
        places = row[inside] * classes + code[inside] % classes
        counts[part] = np.bincount(places, minlength=len(own) * classes).reshape(-1, classes)
    return counts


def _leading(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).view(np.int64)


def _least_common(letters: int | np.ndarray, threshold: float) -> int | np.ndarray:
    """Letters that two sequences of so many together must have in common, in order."""
    return np.ceil(threshold * letters / 2 - 1e-9).astype(np.int64)


def _ratio_at_least(a: str, b: str, threshold: float) -> float | None:
    need = int(_least_common(len(a) + len(b), threshold))
    # A common beginning and a common end belong to a longest common subsequence.
    head = _common_start(a, b)
    tail = min(_common_start(a[::-1], b[::-1]), min(len(a), len(b)) - head)
    short, long = a[head : len(a) - tail], b[head : len(b) - tail]
    rest = lcs_at_least(letter_masks(short), len(short), long, need - head - tail)
    lcs = head + tail + rest
    return indel_ratio(lcs, len(a), len(b)) if rest >= 0 and lcs >= need else None


def _common_start(a: str, b: str) -> int:
    """Letters that both begin with, by halving."""
    least, most = 0, min(len(a), len(b))
    while least < most:
        middle = (least + most + 1) // 2
        if a[least:middle] == b[least:middle]:
            least = middle
        else:
            most = middle - 1
    return least


# -- cosine similarity ---------------------------------------------------------

#: Bytes of a block of unit vectors, and similarities worked on at a time.
BLOCK_BYTES = 2 << 20
TILE = (256, 512)
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _packed_blocks(
    df: DataFrame, key: str, column: str, split: str, block_rows: int | None
) -> DataFrame:
    """One row per block: number, ids, count of train rows, which come first, unit vectors.

    Each vector is shuffled and written once, whatever the number of blocks. Rows are dealt
    by a hash of key and vector; a block is at most a few times ``BLOCK_BYTES`` large. A
    missing vector takes no part.
    """
    spark = df.sparkSession
    ship_package(spark)
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(split).isin(*SIDES) & F.col(column).isNotNull()).select(
        F.col(key).alias("id"),
        (F.col(split) == "train").alias("train"),
        F.col(column).cast("array<double>").alias("vec"),
    )
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    if block_rows is None:
        block_rows = max(1, BLOCK_BYTES // (8 * max(1, seen["width"] or 1)))
    blocks = max(1, ceil(seen["n"] / block_rows))

    def pack(rows: pa.Table) -> pa.Table:
        # Train rows first, then the smallest id, so that equal rows give equal blocks.
        rows = rows.sort_by([("train", "descending"), ("id", "ascending")]).combine_chunks()
        units = _unit_rows(rows.column("vec"))
        train, ids = rows.column("train").to_numpy(), rows.column("id").combine_chunks()
        most = 4 * block_rows
        cut = [slice(at, min(at + most, len(ids))) for at in range(0, len(ids), most)]
        sizes = np.array([c.stop - c.start for c in cut])
        return pa.table(
            {
                "block": pa.array([rows.column("_b")[0].as_py()] * len(cut), pa.int32()),
                "part": pa.array(range(len(cut)), pa.int32()),
                "ids": pa.ListArray.from_arrays(pa.array(offsets_of(sizes).astype(np.int32)), ids),
                "n_train": pa.array([int(train[c].sum()) for c in cut], pa.int32()),
                "units": pa.array([units[c].tobytes() for c in cut], pa.binary()),
            }
        )

    placed = rows.withColumn("_b", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int"))
    packed = (
        placed.repartition(min(blocks, shuffle_width(spark)), "_b")
        .groupBy("_b")
        .applyInArrow(pack, f"block int, part int, ids array<{kind}>, n_train int, units binary")
    )
    return cut_lineage(packed, "blocks")


def _per_cosine_cell(
    df: DataFrame,
    key: str,
    column: str,
    split: str,
    block_rows: int | None,
    emit: Callable[[dict, dict, bool], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """What ``emit`` finds in every pair of blocks, met once, a block also with itself.

    The blocks are read anew for each pair and never shuffled or spilled: what is written
    grows with the rows, the products alone with their square.
    """
    packed = _packed_blocks(df, key, column, split, block_rows)
    sides = [packed.select(F.struct(*packed.columns).alias(s)) for s in ("a", "b")]
    place = [F.struct(F.col(f"{s}.block"), F.col(f"{s}.part")) for s in ("a", "b")]
    # Of two blocks the one whose number is smaller comes first in pairs of an even sum,
    # so every block leads about half of its pairs.
    even = (F.col("a.block") + F.col("b.block")) % 2 == 0
    once = (place[0] == place[1]) | F.when(even, place[0] < place[1]).otherwise(place[0] > place[1])
    cells = sides[0].crossJoin(sides[1]).where(once)
    spark = df.sparkSession
    if int(spark.conf.get(_ARROW_BYTES).rstrip("bB")) > 4 * BLOCK_BYTES:
        spark.conf.set(_ARROW_BYTES, str(4 * BLOCK_BYTES))

    def unpack(row: pa.StructScalar) -> dict:
        ids = row["ids"].values
        units = np.frombuffer(row["units"].as_buffer(), dtype=np.float64).reshape(len(ids), -1)
        return {"block": row["block"].as_py(), "part": row["part"].as_py(), "ids": ids, "n_train": row["n_train"].as_py(), "units": units}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                left, right = unpack(a), unpack(b)
                same = (left["block"], left["part"]) == (right["block"], right["part"])
                yield from emit(left, right, same)

    return cells.mapInArrow(run, schema)


def _stretches(block: dict, rows: int) -> Iterator[tuple[int, int]]:
    """Runs of at most ``rows`` vectors of one side."""
    for start, end in ((0, block["n_train"]), (block["n_train"], len(block["units"]))):
        for at in range(start, end, rows):
            yield at, min(at + rows, end)


def _tiles(left: dict, right: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, first column and similarities of tiles that a cache holds, each of one pair set."""
    for i, i_end in _stretches(left, TILE[0]):
        for j, j_end in _stretches(right, TILE[1]):
            yield i, j, left["units"][i:i_end] @ right["units"][j:j_end].T


def _unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    vectors = vectors.combine_chunks()
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(set(vectors.value_lengths().unique().to_pylist())) > 1:
        raise ValueError("the vectors differ in length")
    m = m.reshape(len(vectors), -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0.0, 1.0, norm)


def _bin_bounds(bins: int) -> list[float]:
    """The least number of every bin, and the least one over the last.

    Numbers are rounded to 12 decimals first, which keeps a vector's similarity to itself
    inside the closed last bin. Rounding never changes the order of two numbers, so halving
    finds the very number where a bin begins.
    """

    def reaches(x: float, k: int) -> bool:
        rounded = float(np.round(np.float64(x), 12))
        return rounded > 1.0 if k == bins else rounded >= 0.0 and int(rounded * bins) >= k

    bounds = []
    for k in range(bins + 1):
        below, above = k / bins - 1e-9, k / bins + 1e-9
        while (middle := (below + above) / 2) not in (below, above):
            below, above = (below, middle) if reaches(middle, k) else (middle, above)
        bounds.append(above)
    return bounds


def cosine_similarity_histogram(
    df: DataFrame,
    key: str,
    column: str = "embedding",
    split: str = "data_split",
    bins: int = HISTOGRAM_BINS,
    block_rows: int | None = None,
) -> DataFrame:
    """(pair_set, bin, n) over [0, 1]; values outside are dropped.

    Within a split the full square counts, both orders and the diagonal.
    """

    bounds = _bin_bounds(bins)

    def count(left: dict, right: dict, same: bool) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((2, 2, bins), dtype=np.int64)
        for i, j, sims in _tiles(left, right):
            # Comparisons with the bins' bounds take a fraction of the time of rounding and counting.
            reached = np.array([np.count_nonzero(sims >= bound) for bound in bounds])
            tally[int(i >= left["n_train"]), int(j >= right["n_train"])] += reached[:-1] - reached[1:]
        # A block meets itself in both orders, another one in one.
        found = {
            "train_train": tally[0, 0] * (1 if same else 2),
            "test_test": tally[1, 1] * (1 if same else 2),
            "train_test": tally[0, 1] if same else tally[0, 1] + tally[1, 0],
        }
        rows = [(name, i, int(v)) for name, n in found.items() for i, v in enumerate(n) if v]
        if rows:
            names, at, n = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["pair_set", "bin", "n"]
            )

    partial = _per_cosine_cell(df, key, column, split, block_rows, count, "pair_set string, bin int, n long")
    return partial.groupBy("pair_set", "bin").agg(F.sum("n").alias("n"))


def cosine_similarity_pairs(
    df: DataFrame,
    key: str,
    min_similarity: float,
    column: str = "embedding",
    split: str = "data_split",
    block_rows: int | None = None,
) -> DataFrame:
    """(pair_set, id_a, id_b, similarity) of the pairs reaching ``min_similarity``.

    Each pair is listed once, a row also with itself; the training side comes
    first in train-test pairs.
    """

    def pairs(left: dict, right: dict, same: bool) -> Iterator[pa.RecordBatch]:
        for i0, j0, sims in _tiles(left, right):
            i, j = np.nonzero(sims >= min_similarity - 1e-12)
            values = sims[i, j]
            i, j = i + i0, j + j0
            if same:
                i, j, values = (x[i <= j] for x in (i, j, values))
            if not len(i):
                continue
            ia, ib = left["ids"].take(pa.array(i)), right["ids"].take(pa.array(j))
            a, b = i < left["n_train"], j < right["n_train"]
            later = np.asarray(pc.less(ib, ia).fill_null(False))
            swap = pa.array((~a & b) | ((a == b) & later))
            sets = np.where(a != b, "train_test", np.where(a, "train_train", "test_test"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets, pa.string()), pc.if_else(swap, ib, ia), pc.if_else(swap, ia, ib), pa.array(values)],
                ["pair_set", "id_a", "id_b", "similarity"],
            )

    kind = df.schema[key].dataType.simpleString()
    schema = f"pair_set string, id_a {kind}, id_b {kind}, similarity double"
    return _per_cosine_cell(df, key, column, split, block_rows, pairs, schema)
