import collections
import re

import pytest
from llm_rows import labels, no_docs, no_labels, odd_docs, odd_rows, table  # noqa: F401

from seqloom.llm import rules

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = collections.Counter(windows)
    covered = {p for i, x in enumerate(windows) if often[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(spark, odd_docs):
    cases = ["a " * 40, "a b c d e f g h " * 2 + "x", " ".join(map(str, range(30))) + " 0 1 2 3 4 5 6 7",
             "x\nx\n\n\n x\nx\r\n", "é 你 😀 #*$%&|<>", "\x1f\xa0 a", "\n", None, "one\x0btwo\x0cthree"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    docs = table(spark, "documents").select("doc_id", "text").unionByName(
        odd_docs.where("doc_id IS NOT NULL").selectExpr("-doc_id AS doc_id", "text")
    ).unionByName(frame.selectExpr("100000 + doc_id AS doc_id", "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = rules.counts(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == base(texts[r["doc_id"]]), texts[r["doc_id"]]


def em(patterns, steps):
    """The same expectation-maximisation, row by row."""
    names = range(len(patterns[0][0]))
    share = rules.START_GOOD
    chance = {(k, v, c): p for k in names for (v, c), p in rules.START.items()}
    for _ in range(steps):
        good = []
        for votes, _n in patterns:
            like = {"good": share, "bad": 1 - share}
            for c in like:
                for k, v in enumerate(votes):
                    like[c] *= chance[k, v, c] if v is not None else 1 - chance[k, 0, c] - chance[k, 1, c]
            good.append(like["good"] / sum(like.values()))
        total = {"good": sum(g * n for g, (_, n) in zip(good, patterns, strict=True))}
        total["bad"] = sum(n for _, n in patterns) - total["good"]
        m = rules.PRIOR_VOTES
        for k in names:
            for v in (0, 1):
                for c in ("good", "bad"):
                    cast = sum((g if c == "good" else 1 - g) * n
                               for g, (votes, n) in zip(good, patterns, strict=True) if votes[k] == v)
                    chance[k, v, c] = (cast + m * rules.START[v, c]) / (total[c] + m)
        share = (total["good"] + m * rules.START_GOOD) / (sum(total.values()) + m)
    return share, chance


def test_em_equals_brute_force(spark, monkeypatch):
    patterns = [((1, None), 500), ((1, 0), 30), ((None, 0), 60), ((None, None), 40), ((0, 0), 12)]
    frame = spark.createDataFrame([(*v, n) for v, n in patterns], "a int, b int, n long")
    monkeypatch.setattr(rules, "MOST_STEPS", 5)
    monkeypatch.setattr(rules, "TOLERANCE", 0.0)
    share, chance = rules.fit_rules(frame, ["a", "b"])
    want_share, want = em(patterns, 5)
    assert share == pytest.approx(want_share)
    for (k, v, c), p in want.items():
        assert chance["ab"[k], v, c] == pytest.approx(p)


def test_verdicts(spark):
    got = rules.judge(table(spark, "documents", "0.01")).toPandas()
    known = got.merge(table(spark, "labels", "0.01").toPandas(), on="doc_id")
    passing = known[~known.base_failed]
    assert passing[passing.quality == 1].kept.mean() > 0.99
    assert passing[passing.quality == 0].kept.mean() < 0.2
    assert not known[known.base_failed].kept.any()


def test_rows_nobody_likes(odd_docs, odd_rows, no_docs):
    got = rules.judge(odd_docs).toPandas()
    assert len(got) == len(odd_rows)
    assert got.kept.notna().all()
    assert not got[got.doc_id.isin([1, 2, 3, 7, 10])].kept.any()
    assert rules.judge(no_docs).count() == 0
