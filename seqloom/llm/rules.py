"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at counts of a text and votes good, votes bad or abstains. How often a
rule casts a vote on good and on bad texts, that is its accuracy, is unknown, as is the
share of good texts; both come from expectation-maximisation over the table of distinct
vote patterns (at most 3 ** rules rows, however many documents). To abstain is
an outcome of its own. The posterior probability of good replaces a conjunction of all rules.

Defined results: null and empty texts have no words and fail the base rules;
repeated rows get equal results; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
KEEP = 0.5
SPACE = r"[\x20\x09-\x0D]+"
PRIOR_VOTES = 20.0
START_GOOD = 0.8
TOLERANCE, MOST_STEPS = 1e-4, 40


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at, one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        "doc_id",
        words.alias("_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
        (F.length(text) - _without(text, "!?")).cast("long").alias("n_bangs"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )
    n = F.size("_words")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(F.col("_words"), i, F.lit(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<long>"))
    second = first.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_upper",
        "n_bangs",
        "n_letters",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    # Only texts with a repeated window go on; for the others the array is empty.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    kept = [c for c in second.columns if c != "_windows"]
    third = second.select(
        *kept,
        F.when(
            repeats,
            F.array_sort(
                F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        )
        .otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))
        .alias("_tagged"),
    )
    # Equal windows are side by side now; a repeated one equals a neighbour.
    tagged = F.col("_tagged")
    shifted = F.concat(F.array(F.lit(None).cast("struct<h: bigint, i: int>")), tagged)
    before = F.zip_with(
        tagged, shifted, lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), (x["h"] == y["h"]).alias("s"))
    )
    fourth = third.select(
        *kept, F.filter(before, lambda x: x["h"].isNotNull()).alias("_before")
    )
    after = F.zip_with(
        F.col("_before"),
        F.slice(F.col("_before"), F.lit(2), F.greatest(F.size("_before"), F.lit(1))),
        lambda x, y: F.when(
            F.coalesce(x["s"], F.lit(False)) | F.coalesce(y["s"], F.lit(False)), x["i"]
        ),
    )
    fifth = fourth.select(
        *kept, F.array_sort(F.filter(after, lambda i: i.isNotNull())).alias("_at")
    )
    steps = F.zip_with(
        F.col("_at"),
        F.slice(F.col("_at"), F.lit(2), F.greatest(F.size("_at"), F.lit(1))),
        lambda x, y: F.least(F.coalesce(y - x, F.lit(WINDOW)), F.lit(WINDOW)),
    )
    return fifth.select(
        *kept,
        F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    )


def _vote(good: Column, bad: Column) -> Column:
    """1 good, 0 bad, null abstains."""
    return F.when(bad, 0).when(good, 1)


def votes() -> dict[str, Column]:
    """The rules, on the columns of ``counts`` for texts with at least one word."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))
    return {
        "length": _vote(c("n_words") >= 50, F.lit(False)),
        "word_length": _vote(
            (c("word_chars") >= 3 * n) & (c("word_chars") <= 10 * n),
            (c("word_chars") < 2 * n) | (c("word_chars") > 15 * n),
        ),
        "symbols": _vote(F.lit(False), 4 * c("n_symbols") > n),
        "symbol_chars": _vote(F.lit(False), 20 * c("n_symbols") > chars),
        "letters": _vote(10 * c("n_letters") >= 9 * chars, 10 * c("n_letters") < 8 * chars),
        "lines": _vote(F.lit(False), 2 * c("n_dup_lines") > lines),
        "repeats": _vote(F.lit(False), 4 * c("n_repeat_words") > n),
        "capitals": _vote(F.lit(False), 2 * c("n_upper") > chars),
        "shouting": _vote(F.lit(False), 4 * c("n_bangs") > n),
    }


#: Chances a rule starts from, and is held to by PRIOR_VOTES imagined texts per class:
#: it votes good on a good and a bad text, bad on a good and a bad text; else it abstains.
START = {(1, "good"): 0.8, (1, "bad"): 0.6, (0, "good"): 0.01, (0, "bad"): 0.25}
Chances = dict[tuple[str, int, str], float]


def _posterior(names: list[str], share: float, chances: Chances) -> Column:
    """P(good | votes); to abstain is an outcome like the two votes."""
    odds = F.lit(math.log(share / (1 - share)))
    for name in names:
        ratio = [math.log(chances[name, v, "good"] / chances[name, v, "bad"]) for v in (0, 1)]
        silent = [1 - chances[name, 0, c] - chances[name, 1, c] for c in ("good", "bad")]
        odds = odds + F.when(F.col(name) == 0, F.lit(ratio[0])).when(
            F.col(name) == 1, F.lit(ratio[1])
        ).otherwise(F.lit(math.log(silent[0] / silent[1])))
    return 1 / (1 + F.exp(-odds))


def fit_rules(patterns: DataFrame, names: list[str]) -> tuple[float, Chances]:
    """EM on rows (votes, n): the share of good texts, and how often each rule casts
    each vote on good and on bad texts."""
    share = START_GOOD
    chances = {(k, v, c): p for k in names for (v, c), p in START.items()}
    for _ in range(MOST_STEPS):
        p, n = F.col("_p"), F.col("n")
        sums = [F.sum(n).alias("n"), F.sum(n * p).alias("good")]
        for i, name in enumerate(names):
            for vote in (0, 1):
                on = F.coalesce((F.col(name) == vote).cast("int"), F.lit(0))
                sums.append(F.sum(n * p * on).alias(f"good{vote}_{i}"))
                sums.append(F.sum(n * (1 - p) * on).alias(f"bad{vote}_{i}"))
        row = patterns.withColumn("_p", _posterior(names, share, chances)).agg(*sums).first()
        if not row["n"]:
            break
        held = {"good": row["good"], "bad": row["n"] - row["good"]}
        new_share = (row["good"] + PRIOR_VOTES * START_GOOD) / (row["n"] + PRIOR_VOTES)
        new = {
            (name, vote, kind): (row[f"{kind}{vote}_{i}"] + PRIOR_VOTES * START[vote, kind])
            / (held[kind] + PRIOR_VOTES)
            for i, name in enumerate(names)
            for vote in (0, 1)
            for kind in ("good", "bad")
        }
        moved = max(abs(new_share - share), *(abs(new[k] - chances[k]) for k in new))
        share, chances = new_share, new
        if moved < TOLERANCE:
            break
    return share, chances


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, votes, p_good and kept of every document."""
    rules = votes()
    names = [f"vote_{k}" for k in rules]
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = written(
        counts(docs).select(
            "*", base_failed.alias("base_failed"), *[v.alias(f"vote_{k}") for k, v in rules.items()]
        ),
        "votes",
    )
    # Texts that fail the base rules are out already; they would only teach what those know.
    passing = rows.where(~F.col("base_failed"))
    patterns = written(passing.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "patterns")
    share, chances = fit_rules(patterns, names)
    scored = rows.withColumn("p_good", _posterior(names, share, chances))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))
