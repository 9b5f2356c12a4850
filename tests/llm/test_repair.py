import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_rows import table
from pyspark.sql import functions as F

from seqloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, no string, code int, chunk string, fault int"
EXTRA = ("?", 9, "?", 9)
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """Code of each (role, text): 0 none, 1 blank, 2 duplicate, 3 truncated."""
    seen, out = set(), []
    for role, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append(1 if not found else 2 if (role, text) in seen else 3 if found[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def best(rows, fault):
    """Least (cost, letters, repaired turns): one suffix table, straight from the rules."""
    inf = (10**9, "", ())
    after = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("", "s"): "s"}

    def add(cost, letter, lines, rest):
        return (cost + rest[0], letter + rest[1], lines + rest[2])

    def insertions(step):
        """``step`` gives each state's best without an insertion first."""
        out = {}
        for q in "u", "a", "s", "":
            options, now, lead, lines = [step[q]], q, 0, ()
            for _ in range(3):
                role = "a" if now == "u" else "u"
                now, lead = role, lead + 1
                lines += (("user:" if role == "u" else "assistant:"),)
                options.append(add(3 * lead, "I" * lead, lines, step[now]))
            out[q] = min(options)
        return out

    table_ = insertions({q: (0, "", ()) if q in ("", "a") else inf for q in ("u", "a", "s", "")})
    for (role, text), f in reversed(list(zip(rows, fault, strict=True))):
        step = {}
        for q in "u", "a", "s", "":
            options = [add(4, "D", (), table_[q])]
            if f in (0, 3):
                more = 3 if f == 3 else 0
                if (q, role[:1]) in after and role[:1]:
                    options.append(add(more, "K", (f"{role}:{text}",), table_[after[q, role[:1]]]))
                for name in "user", "assistant":
                    if (q, name[0]) in after:
                        options.append(add(3 + more, "R", (f"{name}:{text}",), table_[name[0]]))
            step[q] = min(options)
        table_ = insertions(step)
    return table_[""]


def all_edits(rows, fault):
    """The least (cost, letters) among all edits with at most two insertions in a place."""
    inserts = ["", "u", "a", "ua", "au"]
    choices = []
    for (role, _), f in zip(rows, fault, strict=True):
        ways = [("D", "", 4)]
        if f in (0, 3):
            more = 3 if f == 3 else 0
            ways += [("K", role[:1] or "?", more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        choices.append([(("I" * len(i) + w[0]), i + w[1], 3 * len(i) + w[2]) for i in inserts for w in ways])
    choices.append([("I" * len(i), i, 3 * len(i)) for i in inserts])
    return min(
        (sum(c[2] for c in way), "".join(c[0] for c in way))
        for way in itertools.product(*choices)
        if GOOD.fullmatch("".join(c[1] for c in way))
    )


def brute(rows):
    ids = {r[0] for r in rows}
    kept = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept[conv] += [(turn is not None, turn or 0, role, text)] * (2 if kind == 3 else 1)
    out = set()
    for c in ids:
        turns = [t[1] for t in kept[c] if t[0]]
        rows_ = [t[2:] for t in sorted(kept[c])]
        f = faults(rows_)
        cost, letters, lines = best(rows_, f)
        initials = [r[:1] for r, _ in rows_]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.add((c, gaps, f.count(1), f.count(2), f.count(3), illegal, cost, letters, sha))
    return out


def result(df):
    rows = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def make(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "ux", "sys"]
    texts = ["Yes.", "No", "  ", "", None, "Why?", "\t Ah! \n", "x ", "é.", "Yes."]
    return [
        (rng.choice([c, c, None]) if c % 7 == 0 else c, rng.choice([t, t, t, None, t - 1, t + 5]), rng.choice(roles), rng.choice(texts), *EXTRA)
        for c in range(convs)
        for t in range(rng.randint(1, most))
    ]


def test_the_suffix_table_finds_what_all_edits_hold():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "x", ""]), rng.choice(["A.", "b", " ", "c!"])) for _ in range(rng.randint(0, 3))]
        f = faults(rows)
        assert best(rows, f)[:2] == all_edits(rows, f)


@pytest.mark.parametrize("chunk", [1, 3, 2048])
def test_repair_equals_brute_force(spark, chunk):
    rows = make(chunk, 40, 12)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = repair.damage_and_repair(df, chunk)
    assert got.columns == COLUMNS
    assert result(got) == brute(rows)


def test_whole_table_equals_brute_force(spark):
    df = table(spark, "conversations", "0.01")
    assert result(repair.damage_and_repair(df)) == brute([tuple(r) for r in df.collect()])


def test_one_long_conversation_in_chunks(spark):
    rng = random.Random(2)
    rows = [(3, t, rng.choice(["user", "assistant"]), rng.choice(["A.", "B", f"{t}!"]), *EXTRA) for t in range(500)]
    rows += [(4, t, "system", "Same.", *EXTRA) for t in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(repair.damage_and_repair(df, 7)) == brute(rows)


def test_guesses_are_run_again_until_they_differ_by_a_constant(spark):
    """Blank turns must be deleted, so what lies behind them decides what lies before them."""
    codes, length = np.full((1, 5), 3 + 4 * 1), np.array([5])
    behind = np.array([[0, 6, 3, 0], [3, 3, 0, 3]])
    one, other = (repair.cost_to_go(codes, length, b[None]) for b in behind)
    assert (one != other).any()
    rows = [(1, t, "user", " ", *EXTRA) for t in range(30)] + [(1, 40, "user", "Q?", *EXTRA)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(repair.damage_and_repair(df, 4)) == brute(rows)


def test_empty_table_nulls_and_nothing_left(spark):
    assert repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, gone, "user", "Hi.", *EXTRA), (None, None, None, None, *EXTRA), (6, None, "user", None, *EXTRA)]
    got = repair.damage_and_repair(spark.createDataFrame(rows, SCHEMA))
    assert result(got) == brute(rows)
    row = got.where(F.col("conv_id") == 5).first()
    assert (row.cost, row.audit, row.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_turns_at_both_ends_of_a_long(spark):
    big = 2**63 - 1
    rows = [(1, -big, "user", "a.", *EXTRA), (1, big, "assistant", "b.", *EXTRA), (1, 0, "user", "c.", *EXTRA)]
    assert repair.damage_and_repair(spark.createDataFrame(rows, SCHEMA)).first().gaps is None
