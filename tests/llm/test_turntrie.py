import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from llm_rows import table
from pyspark.sql import functions as F

from seqloom.llm import turntrie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node long, n int, x string, run int"


def toward_zero(c):
    return c - (abs(c) % 20) * (1 if c >= 0 else -1)


def brute(rows):
    """All nodes with their columns, straight from the definition."""
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(toward_zero(c), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (count(p[-1][1]) if p else 0)
    return {
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest(),
        )
        for p, m in members.items()
    }


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def result(df):
    rows = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def make(seed, convs, most, words=3):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-70, 400), convs):
        for t in range(rng.randint(1, most)):
            text = None if rng.random() < 0.1 else " ".join(rng.choices("ab c", k=words))
            out.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None, ""]), text, *"?", 1, 2, "x", 3))
    return out + out[:3]


@pytest.mark.parametrize("band, run", [(2, 3), (3, 4), (16, 1024)])
def test_trie_equals_brute_force(spark, monkeypatch, band, run):
    monkeypatch.setattr(turntrie, "RUN", run)
    monkeypatch.setattr(turntrie, "ENDS", 2)
    rows = make(band, 60, 9, words=1) + [(500, t, "user", "same", "?", 1, 2, "x", 3) for t in range(40)]
    rows += [(501, t, "user", "same", "?", 1, 2, "x", 3) for t in range(37)] + [(None, 1, "user", "x", "?", 1, 2, "x", 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = turntrie.prefix_trie(df, band)
    assert got.columns == COLUMNS
    assert result(got) == brute(rows)


def test_whole_table_equals_brute_force(spark):
    df = table(spark, "conversations", "0.01")
    assert result(turntrie.prefix_trie(df)) == brute([tuple(r) for r in df.collect()])


def test_many_equal_conversations_and_long_ones(spark):
    rows = [(20 * c, t, "user", f"turn {t}", "?", 1, 2, "x", 3) for c in range(300) for t in range(2)]
    rows += [(7, t, "user", f"long {t}", "?", 1, 2, "x", 3) for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(turntrie.prefix_trie(df)) == brute(rows)


def test_empty_table_and_table_without_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turntrie.prefix_trie(empty).count() == 0
    nothing = spark.createDataFrame([(None, 0, "user", "x", "?", 1, 2, "x", 3)], SCHEMA)
    assert turntrie.prefix_trie(nothing).count() == 0


def test_conversation_without_turns_is_a_member_of_the_root(spark):
    ids = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0][:2]
    rows = [(c, 0, "user", "only turn", "?", 1, 2, "x", 3) for c in ids]
    got = turntrie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert result(got) == brute(rows)
    root = got.where(F.col("depth") == 0).first()
    assert (root.n_convs, root.n_children, root.n_leaves) == (2, 0, 1)
