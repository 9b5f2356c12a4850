import collections
import math
import random
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import lcs
from seqloom.functions.lcs import indel_ratio, lcs_at_least, lcs_length, letter_masks
from seqloom.operators import pairs

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@cache
def ratio(a, b):
    if a > b:
        return ratio(b, a)
    return indel_ratio(table_lcs(a, b), len(a), len(b))


def test_known_ratios():
    for a, b, want in (
        ("KPTAE", "KTAQ", 6 / 9), ("kitten", "sitting", 8 / 13), ("AB", "CD", 0.0), ("X", "X", 1.0), ("", "", 1.0), ("A", "", 0.0),
    ):
        assert indel_ratio(lcs_length(letter_masks(a), len(a), b), len(a), len(b)) == pytest.approx(want)


def test_bit_parallel_equals_table():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choices("ACDE", k=rng.randint(0, 150)))
        b = "".join(rng.choices("ACDE", k=rng.randint(0, 300)))
        want = table_lcs(a, b)
        assert lcs_length(letter_masks(a), len(a), b) == want
        assert lcs_at_least(letter_masks(a), len(a), b, want) == want
        assert lcs_at_least(letter_masks(a), len(a), b, want + 1) in (want, -1)


@pytest.fixture(scope="module")
def family(spark):
    """A third of the rows are near copies of one text; short and repetitive ones too."""
    rng = random.Random(5)

    def mutate(s, n):
        s = list(s)
        for _ in range(n):
            i = rng.randrange(len(s))
            kind = rng.random()
            if kind < 0.4:
                s[i] = rng.choice(ALPHABET)
            elif kind < 0.7 and len(s) > 2:
                del s[i]
            else:
                s.insert(i, rng.choice(ALPHABET))
        return "".join(s)

    hot = "".join(rng.choices(ALPHABET, k=180))
    texts = [mutate(hot, rng.randint(0, 14)) for _ in range(40)]
    texts += ["".join(rng.choices(ALPHABET, k=rng.randint(1, 130))) for _ in range(30)]
    base = ["".join(rng.choices(ALPHABET, k=n)) for n in (10, 12, 20, 40, 95, 99, 101, 104, 110)]
    texts += [mutate(b, m) for b in base for m in (0, 1, 2, 4)]
    texts += ["A" * n for n in (9, 10, 11, 19, 20, 21, 100, 103)] + ["AC" * 60, "AC" * 61]
    rows = [(i, t, "test" if i % 4 == 0 else "train") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "seq_id long, sequence string, data_split string"), rows


@pytest.mark.parametrize("threshold", [0.9, 0.95, 0.98])
def test_near_identical_equals_brute_force(family, threshold):
    df, rows = family
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    items = sorted((i, t) for t, i in first.items())
    want = {
        (i, j): ratio(a, b)
        for x, (i, a) in enumerate(items)
        for j, b in items[x + 1 :]
        if ratio(a, b) >= threshold
    }
    got = {(r["id_a"], r["id_b"]): r["ratio"] for r in pairs.near_identical_join(df, threshold).collect()}
    assert len(want) > 20 and got == pytest.approx(want)


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.95, 0.99])
def test_promised_segments_stand_whole_in_the_partner(threshold):
    """However the letters are dropped and put in, enough segments stay, near their place."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(5, 700))
        a = "".join(rng.choice(list("ACDE"), n))
        k = int(pairs.segment_widths(np.array([n]), threshold)[0])
        budget = int(pairs.edit_budget(np.array([n]), threshold)[0])
        b = list(a)
        for _ in range(rng.integers(0, budget + 1)):
            at = int(rng.integers(0, len(b)))
            if rng.random() < 0.4:
                del b[at]
            else:
                b.insert(at, "Y")
        b = "".join(b)
        if len(b) < n or ratio(a, b) < threshold or not budget:
            continue
        assert k
        edits = (1 - threshold) * (n + len(b)) + 1e-9
        met = 0
        for p in range(0, n - k + 1, k):
            met += any(b[q : q + k] == a[p : p + k] for q in range(max(0, int(p - edits)), min(len(b), int(p + edits)) + 1))
        assert met >= n // k - budget >= 1


def test_near_identical_writes_sequences_not_tokens(spark, family, monkeypatch):
    """Nothing is shuffled per k-mer, and many small blocks find the pairs of a few large ones."""
    df, rows = family
    odd = spark.createDataFrame([(500, "", "train"), (501, rows[3][1], "train")], df.schema)
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    want = {tuple(r) for r in pairs.near_identical_join(df).collect()}
    monkeypatch.setattr(pairs, "BLOCK_LETTERS", 3000)
    try:
        blocks = pairs._sequence_blocks(df.unionByName(odd), 0.95, "seq_id")
        sizes = [r[0] for r in blocks.select(F.size("ids")).collect()]
        assert len(sizes) > 15 and sum(sizes) == len({t for _, t, _ in rows})
        found = pairs.near_identical_join(df.unionByName(odd))
        plan = found._jdf.queryExecution().toString()
        assert "Exchange hashpartitioning" not in plan and "Generate" not in plan
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set(conf, before)
    assert set(got) == want and len(got) == len(want) > 20


def test_banded_lcs_is_exact(monkeypatch):
    rng = np.random.default_rng(7)
    for _ in range(400):
        monkeypatch.setattr(lcs, "STRETCH", int(rng.choice([1, 7, 30, 256])))
        letters = list("ACDEF")[: int(rng.integers(1, 6))]
        a = "".join(rng.choice(letters, int(rng.integers(0, 120))))
        b = list(a if rng.random() < 0.8 else rng.choice(letters, int(rng.integers(0, 120))))
        for _ in range(int(rng.integers(0, 30))):
            if rng.random() < 0.5 and b:
                del b[int(rng.integers(0, len(b)))]
            else:
                b.insert(int(rng.integers(0, len(b) + 1)), str(rng.choice(letters)))
        b = "".join(b)
        want = lcs_length(letter_masks(a), len(a), b)
        for need in (-3, 0, want - 5, want, want + 1, int(rng.integers(0, 130))):
            got = lcs_at_least(letter_masks(a), len(a), b, need)
            assert got == (want if want >= need else -1)


def test_pairs_without_common_letters_are_not_compared(monkeypatch):
    """Texts that share segments alone are told apart in bulk, by letters or by neighbours."""
    rng = np.random.default_rng(5)
    shared, kinds = "".join(rng.choice(list("ACDE"), 400)), ["FGHI", "KLMN", "PQRS"]
    texts = [shared + "".join(rng.choice(list(kinds[i % 3]), 500)) for i in range(30)]
    ordered = [shared + "FGHIKLMNPQRS" * 40, shared + "FHKMPRGILNQS" * 40]
    near = ordered[0][:-9] + "A"
    compared = []
    exact = pairs._ratio_at_least
    monkeypatch.setattr(pairs, "_ratio_at_least", lambda a, b, t: compared.append((a, b)) or exact(a, b, t))
    items = sorted([*texts, *ordered, near], key=len)
    ids = list(range(len(items)))
    found = list(pairs._SegmentIndex(ids, items, 0.95).partners(ids, items))
    assert {frozenset((items[a], items[b])) for a, b, _ in found} == {frozenset((ordered[0], near))}
    shown = {frozenset(x) for x in compared}
    of = lambda x: next((k for k in kinds if set(x[400:]) <= set(k)), x)
    assert frozenset(ordered) not in shown
    assert all(of(x) == of(y) for x, y in map(tuple, shown - {frozenset((ordered[0], near))}))


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.95, 0.99])
def test_no_near_pair_is_told_apart_in_bulk(threshold):
    rng = np.random.default_rng(6)
    letters = list("ACDEFGHIKLMNPQRSTVWY\u00e9\u4e2d\U0001f600")
    a, b = [], []
    for _ in range(120):
        one = list(rng.choice(letters, int(rng.integers(12, 500))))
        other = list(one)
        for _ in range(rng.integers(1, int((1 - threshold) * 2 * len(one)) + 3)):
            if rng.random() < 0.5 and len(other) > 1:
                del other[int(rng.integers(0, len(other)))]
            else:
                other.insert(int(rng.integers(0, len(other) + 1)), str(rng.choice(letters)))
        a.append("".join(one))
        b.append("".join(other))
    index = pairs._SegmentIndex(list(range(len(a))), a, threshold)
    every = np.arange(len(a))
    kept, _ = index._with_common_classes(every, every, b, np.array([len(s) for s in b]))
    near = {i for i, (x, y) in enumerate(zip(a, b)) if ratio(x, y) >= threshold}
    assert len(near) > 10 and near <= set(kept.tolist())
    for i, (x, y) in enumerate(zip(a, b)):
        assert pairs._ratio_at_least(x, y, threshold) == (pytest.approx(ratio(x, y)) if i in near else None)


def test_segments_are_met_slice_by_slice(family, monkeypatch):
    _, rows = family
    items = sorted({t: i for i, t, _ in reversed(rows)}.items(), key=lambda x: x[1])
    texts, ids = zip(*items)
    want = {(i, j) for x, (a, i) in enumerate(items) for b, j in items[x + 1 :] if ratio(a, b) >= 0.9}
    for letters, matches in ((1 << 20, 1 << 20), (300, 50)):
        monkeypatch.setattr(pairs, "SLICE_LETTERS", letters)
        monkeypatch.setattr(pairs, "MATCHES", matches)
        index = pairs._SegmentIndex(list(ids), list(texts), 0.9)
        found = [(i, j) for i, j, _ in index.partners(list(ids), list(texts))]
        assert set(found) == want and len(found) == len(want)


def brute_sets(rows):
    sides = {s: sorted({t for _, t, d in rows if d == s}) for s in ("train", "test")}
    for s in sides:
        for i, a in enumerate(sides[s]):
            for b in sides[s][i:]:
                yield f"{s}_{s}", a, b, ratio(a, b)
    for a in sides["train"]:
        for b in sides["test"]:
            yield "train_test", a, b, ratio(a, b)


def test_identity_histogram_and_pairs(family):
    df, rows = family
    want, listed = {}, set()
    for name, a, b, r in brute_sets(rows):
        if r > 0 or name == "train_test":
            key = (name, min(int(r * 20), 19))
            want[key] = want.get(key, 0) + 1
        if r >= 0.7:
            listed.add((name, a, b, round(r, 9)))
    got = {(r["pair_set"], r["bin"]): r["n"] for r in pairs.sequence_identity_histogram(df, block_rows=16).collect()}
    assert got == want
    rows_ = pairs.sequence_identity_pairs(df, 0.7, block_rows=16).collect()
    assert {(r["pair_set"], r["sequence_a"], r["sequence_b"], round(r["ratio"], 9)) for r in rows_} == listed
    assert len(rows_) == len(listed)
    with pytest.raises(ValueError):
        pairs.sequence_identity_pairs(df, 0.0)


def test_cosine_blocks_equal_one_matrix(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(90, 6))
    m[7] = 0.0
    side = np.array(["train", "test", "val"])[rng.integers(0, 3, 90)]
    df = spark.createDataFrame(
        [(i, m[i].tolist(), str(side[i])) for i in range(90)], "seq_id long, embedding array<double>, data_split string"
    )
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = m / np.where(norm == 0, 1, norm)
    want = {}
    for name, a, b in (("train_train", "train", "train"), ("test_test", "test", "test"), ("train_test", "train", "test")):
        sims = np.round(unit[side == a] @ unit[side == b].T, 12).ravel()
        counts, _ = np.histogram(sims[(sims >= 0) & (sims <= 1)], bins=20, range=(0, 1))
        want |= {(name, i): int(n) for i, n in enumerate(counts) if n}
    got = pairs.cosine_similarity_histogram(df, "seq_id", block_rows=20).collect()
    assert {(r["pair_set"], r["bin"]): r["n"] for r in got} == want

    sims = unit @ unit.T
    used = [i for i in range(90) if side[i] != "val"]
    listed = {
        tuple(sorted((i, j))) for i in used for j in used if i <= j and sims[i, j] >= 0.6
    }
    rows = pairs.cosine_similarity_pairs(df, "seq_id", 0.6, block_rows=20).collect()
    assert {tuple(sorted((r["id_a"], r["id_b"]))) for r in rows} == listed and len(rows) == len(listed)
    assert all(side[r["id_a"]] == "train" for r in rows if r["pair_set"] == "train_test")


def test_cosine_vectors_are_written_once(spark):
    """The shuffle grows with the rows, not with their pairs; blocks are read for each pair."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist(), "train" if i % 3 else "test") for i in range(300)]
    rows += [(None, rows[0][1], "test"), (400, None, "train"), (401, [float("nan")] * 8, "test"), (5, rows[5][1], "test")]
    df = spark.createDataFrame(rows, "seq_id long, embedding array<double>, data_split string")
    blocks = pairs._packed_blocks(df, "seq_id", "embedding", "data_split", 10)
    assert blocks.count() > 20 and blocks.agg(F.sum(F.size("ids"))).first()[0] == 303
    want = collections.Counter()
    m = np.array([r[1] for r in rows[:300]] + [rows[0][1], rows[5][1]])
    train = np.array([r[2] == "train" for r in rows[:300]] + [False, False])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 12)
    for name, s in (("train_train", sims[train][:, train]), ("test_test", sims[~train][:, ~train]), ("train_test", sims[train][:, ~train])):
        inside = s[(s >= 0) & (s <= 1)]
        for i, n in zip(*np.unique(np.minimum((inside * 20).astype(int), 19), return_counts=True), strict=True):
            want[name, i] += n
    for size in (10, 64, None):
        got = pairs.cosine_similarity_histogram(df, "seq_id", block_rows=size).collect()
        assert {(r["pair_set"], r["bin"]): r["n"] for r in got} == dict(want)
    found = pairs.cosine_similarity_pairs(df, "seq_id", 0.9, block_rows=10).collect()
    order = np.arange(len(m))
    assert len(found) == ((unit @ unit.T >= 0.9 - 1e-12) & (order[:, None] <= order[None, :])).sum()
    with pytest.raises(Exception, match="differ in length"):
        pairs.cosine_similarity_pairs(
            spark.createDataFrame([(0, [1.0], "train"), (1, [1.0, 2.0], "train")], df.schema), "seq_id", 0.9
        ).collect()


def test_bin_bounds_are_those_of_rounded_numbers():
    for bins in (1, 7, 20):
        bounds = np.array(pairs._bin_bounds(bins))
        near = np.concatenate([bounds, np.nextafter(bounds, -1), np.nextafter(bounds, 2), np.arange(bins + 1) / bins])
        rounded = np.round(near, 12)
        want = np.where((rounded >= 0) & (rounded <= 1), np.minimum((rounded * bins).astype(int), bins - 1), -1)
        at = np.searchsorted(bounds, near, side="right") - 1
        assert (np.where(at == bins, -1, at) == want).all()
