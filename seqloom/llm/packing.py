"""Best-fit packing of tokenized documents into sequences of fixed capacity.

A document's tokens are its ids followed by an end id; only documents longer than
the capacity are cut. Packing runs in three steps:

1. Range sort. The sort key, a length, has at most ``capacity`` values, so the
   documents are put in order by a counting sort: every task numbers its own
   pieces per length, and sums over the counts of the tasks before it turn that
   into a rank among all pieces of the length. No task sees a whole length.
2. Bulk-synchronous rounds. Pieces of one length, and gaps of one size that were
   opened together, are kept as runs (first rank, count). A round takes the
   longest length left: its run sweeps to the successor, the smallest gap that
   holds it; by rank, as many pieces as the gap run has sequences win, the
   others go on to the next larger gap in the following round; the gaps shrink
   and new sequences open when no gap holds the length. The runs are as many as
   lengths and sizes allow, whatever the number of documents.
3. Placement. Each piece finds its run by length and rank.

Defined results: a null text counts as empty and packs as the end id alone;
repeated rows are packed once each; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written
from .textops import LOWER, Hasher, Texts, slices, words

CAPACITY = 2048
END_ID = 0
#: Largest size in bytes of the placement runs that are sent to the tasks.
MAX_RUN_BYTES = 64_000_000

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = _LETTER
#: Bytes whose word is left to the tokenizer whole: control characters, the
#: apostrophe of contractions, and all beyond ASCII but the letters U+00C0 to U+00FF.
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[127] = _ODD[39] = True
_ODD[0xC0:] = True
_ODD[0xC3] = False
_ODD[np.frombuffer(b"\t\n\x0b\x0c\r", np.uint8)] = False


class Encoder:
    """Ids of a word-level tokenizer file for many texts at once.

    White space never belongs to a token, and a plain word's pre-tokens follow
    from character kinds alone: a run of letters, a single digit, a run of other
    characters. Pre-tokens are found and hashed on the bytes of all texts; the
    tokenizer sees each distinct one once, as small letters. A word with any other
    character goes to the tokenizer whole, as it is. What is remembered between
    calls is bounded by ``remember`` pre-tokens.
    """

    def __init__(self, path: str, remember: int = 2_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._lean = Tokenizer.from_file(path)
        self._lean.normalizer = None
        self._lean.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        self._lean.model._resize_cache(0)  # each pre-token comes once
        vocab = self._whole.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._remember = remember
        self._forget()

    def _forget(self) -> None:
        self._hash = np.empty(0, np.uint64)  # sorted
        self._at = np.empty(0, np.int64)  # of each hash: first id and number of ids
        self._n = np.empty(0, np.int64)
        self._ids = [np.empty(0, "<u4")]
        self._size = 0

    def _cut(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Small letters, starts and ends of pre-tokens, and which are whole odd words."""
        raw = texts.data
        data = LOWER[raw]
        n = len(raw)
        after = np.append(raw[1:], 0)
        latin = np.flatnonzero(raw == 0xC3) + 1
        latin = latin[latin < n]
        second = raw[latin]
        data[latin] += np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), 32, 0).astype(
            np.uint8
        )
        odd = _ODD[raw]
        odd[latin] |= (second == 0x97) | (second == 0xB7)
        odd |= (raw == 60) & (after == 124)  # "<|" may begin a special token
        kind = _KIND[raw]
        found = words(texts)
        start = kind[1:] != kind[:-1]
        start = np.concatenate([[True], start | (kind[1:] == _DIGIT)]) & (kind != _SPACE)
        start[found.start] = True
        stop = np.append(start[1:] | (kind[1:] == _SPACE), True) & (kind != _SPACE)
        stop[found.end - 1] = True
        sums = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
        odd_words = sums[found.end] > sums[found.start]
        whole = np.zeros(0, bool)
        if odd_words.any():
            edge = np.zeros(n + 1, np.int32)
            edge[found.start[odd_words]] += 1
            np.subtract.at(edge, found.end[odd_words], 1)
            inside = np.cumsum(edge[:-1]) > 0
            data[inside] = raw[inside]
            start[inside] = stop[inside] = False
            start[found.start[odd_words]] = True
            stop[found.end[odd_words] - 1] = True
            whole = inside[np.flatnonzero(start)]
        begin = np.flatnonzero(start)
        return data, begin, np.flatnonzero(stop) + 1, whole if len(whole) else np.zeros(len(begin), bool)

    def _learn(self, hashes: np.ndarray, tokens: list[bytes], whole: np.ndarray) -> None:
        plain = [t.decode() for t, w in zip(tokens, whole.tolist(), strict=True) if not w]
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        made = self._lean.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in made] or [np.empty(0, "<u4")])
        stops = np.flatnonzero(self._ends[ids]) + 1
        if len(stops) != len(plain):
            raise ValueError("a pre-token did not come back as one word")
        odd = self._whole.encode_batch(
            [t.decode() for t, w in zip(tokens, whole.tolist(), strict=True) if w],
            add_special_tokens=False,
        )
        count = np.zeros(len(tokens), np.int64)
        at = np.zeros(len(tokens), np.int64)
        count[~whole] = np.diff(stops, prepend=0)
        at[~whole] = stops - count[~whole]
        more = [np.array(e.ids, "<u4") for e in odd]
        count[whole] = [len(m) for m in more]
        at[whole] = len(ids) + np.cumsum(count[whole]) - count[whole]
        fresh = np.concatenate([ids, *more])
        order = np.argsort(hashes)
        put = np.searchsorted(self._hash, hashes[order])
        self._hash = np.insert(self._hash, put, hashes[order])
        self._at = np.insert(self._at, put, at[order] + self._size)
        self._n = np.insert(self._n, put, count[order])
        self._ids.append(fresh)
        self._size += len(fresh)

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each text start."""
        if len(self._hash) > self._remember:
            self._forget()
        if not len(texts.data):
            return np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        data, start, stop, whole = self._cut(texts)
        codes, distinct = pd.factorize(Hasher(data)(start, stop))
        place = np.searchsorted(self._hash, distinct)
        place[place == len(self._hash)] = 0
        new = self._hash[place] != distinct if len(self._hash) else np.ones(len(distinct), bool)
        if new.any():
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            first = first[new]
            raw = data.tobytes()
            tokens = [raw[i:j] for i, j in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
            self._learn(distinct[new], tokens, whole[first])
            place = np.searchsorted(self._hash, distinct)
        if len(self._ids) > 1:
            self._ids = [np.concatenate(self._ids)]
        n = self._n[place][codes]
        ends = np.cumsum(n)
        take = np.repeat(self._at[place][codes] - (ends - n), n)
        take += np.arange(len(take))
        of = np.concatenate([[0], ends])[np.searchsorted(start, texts.starts)]
        return self._ids[0][take], of


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"
)


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Cut every document into pieces of at most ``capacity`` tokens.

    ``number`` counts the pieces of one length within the task ``part``.
    ``with_ids`` adds the token ids as a binary of little-endian 32-bit values.
    """
    prepare(docs.sparkSession)
    names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids_of = batch.column("doc_id")
            for texts in slices(batch.column("text")):
                ids, of = encode(texts)
                raw, at = memoryview(ids.tobytes()), (4 * of).tolist()
                doc, piece, start, crc, length, kept = [], [], [], [], [], []
                for i, (low, high) in enumerate(zip(at, at[1:], strict=False)):
                    # The end id follows a document's last id.
                    for k in range(0, high - low + 4, 4 * capacity):
                        own = raw[low + k : min(low + k + 4 * capacity, high)]
                        last = low + k + 4 * capacity > high
                        doc.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(own) // 4 + last)
                        crc.append(zlib.crc32(end, zlib.crc32(own)) if last else zlib.crc32(own))
                        if with_ids:
                            kept.append(bytes(own) + end * last)
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                count = np.bincount(size, minlength=capacity + 1)
                number = np.empty(len(size), np.int64)
                number[order] = np.arange(len(size)) - (np.cumsum(count) - count)[size[order]]
                number += seen[size]
                seen += count
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_of.take(pa.array(np.array(doc, np.int64) + texts.first)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(size),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(len(size), part, np.int32)),
                        pa.array(number),
                        *([pa.array(kept, pa.binary())] * with_ids),
                    ],
                    names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Place all pieces, given how many there are of each length.

    Returns rows (length, first rank, first sequence, offset, count), ordered by
    length and rank, and the number of sequences. The pieces with ranks
    first .. first + count - 1 go to as many sequences in a row.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    opened = 0
    placed: list[tuple[int, int, int, int, int]] = []

    def add(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)  # the successor gap
            if at == len(sizes):
                new = max(left // (capacity // length), 1)
                add(capacity, opened, new)
                opened += new
                continue
            size = sizes[at]
            first, count = gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                sizes.pop(at)
            won = min(left, count)
            placed.append((length, rank, first, capacity - size, won))
            add(size, first + won, count - won)
            add(size - length, first, won)
            rank += won
            left -= won
    rows = np.array(placed, np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))], opened


def _ranked(pieces: DataFrame) -> DataFrame:
    """Rank of every piece among all pieces of its length, from the tasks' counts."""
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy("length")
        .orderBy("part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    base = counts.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    return pieces.join(base, ["part", "length"]).withColumn("_rank", F.col("_b") + F.col("number"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the written result of ``tokenized_pieces``."""
    spark = pieces.sparkSession
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # <= capacity rows
    runs, _ = best_fit_runs({int(r["length"]): int(r["n"]) for r in found}, capacity)
    if runs.nbytes > MAX_RUN_BYTES:
        raise ValueError(f"placement runs take {runs.nbytes} bytes, over {MAX_RUN_BYTES}")
    sent = spark.sparkContext.broadcast(runs)
    names = [c for c in pieces.columns if c not in ("part", "number")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, first, offset, _ = sent.value.T
        # Ranks stay below 2**50 and lengths below 2**13, so both fit one sort key.
        keys = (length << 50) | rank
        for batch in batches:
            own = (batch.column("length").to_numpy() << 50) | batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, own, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array(first[at] + batch.column("_rank").to_numpy() - rank[at]),
                    pa.array(offset[at]),
                ],
                [*names, "sequence_id", "offset"],
            )

    ranked = _ranked(pieces)
    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes if c in names)
    return ranked.select(*names, "_rank").mapInArrow(
        run, schema + ", sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Tokenize, cut and pack; the pieces are written once to the shared scratch folder."""
    return pack(written(tokenized_pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)
