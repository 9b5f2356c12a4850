"""Repair of conversation structure by a parallel Viterbi pass with rank convergence.

``damaged`` spoils a table of turns in a repeatable way; ``repair`` finds the cheapest edits
that make the role initials of a conversation match ``(s?(ua)+)?``. A turn is kept (free, if
its initial fits), given role user or assistant (3), or deleted (4; blank and duplicate turns
must be); an empty user or assistant turn may be inserted anywhere (3); a truncated turn that
stays adds 3. Of the cheapest edits, those whose initials (Delete, Insert, Keep, Rerole) make
the ASCII-least string are taken.

The automaton has four states: nothing yet, after s, after u, after a. A vector holds the
least cost to go from each; one turn changes the vector behind it into the one before it.
Conversations are cut into chunks of ``CHUNK`` turns, which all start at once from a guess
of the vector behind them. A chunk whose guess differs from what its right neighbour then
reports by more than a constant is run again from the reported vector, until none differs:
the vectors soon depend on no more than a constant, since four states forget what follows.
Then each chunk traces its least letters from every state it may be entered in, and the
entries are stitched by composing these maps of four states. In tasks numpy steps through
many chunks at once.

Faults, of which a turn's first counts: blank (no character but white space), duplicate
(its role and text stood earlier in the conversation), truncated (the last character that is
no white space is none of ``.!?``).

Defined results: nulls become one space, in role, text and the key of the damage; rows
without conv_id are one conversation, whose id is null; turns go by turn with nulls first,
ties by role, then text; repeated rows are turns of their own; roles with other initials
can be given a role or deleted; a conversation without turns after the damage has zeros, an
empty audit and the empty string's hash; ``gaps`` is null where it exceeds a long; an empty
table gives an empty result. A conversation may hold most rows: it is numbered and decided
in pieces, and only the hash of its repaired text is one stream, which holds one batch at a
time. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import join_same
from ..session import shuffle_width
from .common import arrow, prepare, written
from .turns import SPACES, WORD, numbered

CHUNK = 2048
DAMAGES = 20
#: Costs.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where an inserted or new role leads.
NEXT = np.array([2, 2, 3, 2])
#: Where keeping an initial leads from each state; -1 is not allowed.
INITIALS = "uas"
KEEP = np.array([[2, 2, -1, 2], [-1, -1, 3, -1], [1, -1, -1, -1], [-1, -1, -1, -1]])
FAR = np.int64(1) << 40
#: Cost to go behind the last turn.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage of each row by its (conv_id, turn)."""
    space = F.lit(" ")
    shown = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % DAMAGES).alias("kind"),
    ).where("kind != 0")
    kind, text = F.col("kind"), F.col("text")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _closed(costs: np.ndarray) -> np.ndarray:
    """The costs with up to two insertions before; more only come back to a state."""
    once = costs[:, NEXT]
    return np.minimum(np.minimum(costs, INSERT + once), 2 * INSERT + once[:, NEXT])


def _moves(ahead: np.ndarray, code: np.ndarray) -> np.ndarray:
    """[chunk, state, D K R]: cost of each way to spend a turn; a code is initial + 4 * fault."""
    initial, fault = code & 3, code >> 2
    out = np.full((len(code), 4, 3), FAR)
    out[:, :, 0] = DELETE + ahead
    add = np.where(fault == 3, CUT, 0)[:, None]
    may = ((fault == 0) | (fault == 3))[:, None]
    to = KEEP[initial]
    kept = np.take_along_axis(ahead, np.maximum(to, 0), 1) + add
    out[:, :, 1] = np.where(may & (to >= 0), kept, FAR)
    out[:, :, 2] = np.where(may, ahead[:, NEXT] + REROLE + add, FAR)
    return out


def _padded(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks as one matrix, longest first, and their lengths in that order; see ``_ordered``."""
    length = np.array([len(c) for c in codes])
    out = np.zeros((len(codes), int(length.max(initial=0))), np.int64)
    for row, c in zip(out, codes, strict=True):
        row[: len(c)] = c
    return out, length


def cost_to_go(codes: np.ndarray, length: np.ndarray, behind: np.ndarray, every: bool = False) -> np.ndarray:
    """Vectors before the first turn of each chunk, less their minimum; with ``every`` before each turn."""
    now = behind.astype(np.int64)
    trail = np.zeros((codes.shape[1] + 1, len(codes), 4), np.int64) if every else None
    if every:
        trail[length, np.arange(len(codes))] = now
    for t in range(codes.shape[1] - 1, -1, -1):
        on = np.flatnonzero(length > t)
        now[on] = _closed(_moves(now[on], codes[on, t]).min(2))
        if every:
            trail[t, on] = now[on]
    return trail if every else now - now.min(1, keepdims=True)


def trace(codes: np.ndarray, length: np.ndarray, behind: np.ndarray, last: np.ndarray):
    """Least letters from each state: exit [chunk, 4], cost [chunk, 4] and letters [chunk][4]."""
    trail = cost_to_go(codes, length, behind, every=True)
    n = len(codes)
    state = np.tile(np.arange(4), (n, 1))
    cost = np.zeros((n, 4), np.int64)
    # At most two insertions and one letter for each turn, and two insertions at the end.
    letters = np.zeros((n, 4, 3 * codes.shape[1] + 2), "S1")
    filled = np.zeros((n, 4), np.int64)

    def write(on: np.ndarray, letter: bytes) -> None:
        rows, cols = np.nonzero(on)
        letters[rows, cols, filled[rows, cols]] = letter
        filled[rows, cols] += 1

    for t in range(codes.shape[1]):
        live = (length > t)[:, None]
        moves = _moves(trail[t + 1], codes[:, t])
        open_ = np.broadcast_to(live, (n, 4)).copy()
        before = trail[t]
        for _ in range(3):  # a deletion, or an insertion and the same question again
            here = np.take_along_axis(before, state, 1)
            way = np.take_along_axis(moves, state[:, :, None], 1)
            gone = open_ & (way[:, :, 0] == here)
            write(gone, b"D")
            cost[gone] += DELETE
            open_ &= ~gone
            new = open_ & (INSERT + np.take_along_axis(before, NEXT[state], 1) == here)
            kept = open_ & ~new & (way[:, :, 1] == here)
            given = open_ & ~new & ~kept
            add = np.broadcast_to(np.where(codes[:, t] >> 2 == 3, CUT, 0)[:, None], (n, 4))
            write(kept, b"K")
            cost[kept] += add[kept]
            write(given, b"R")
            cost[given] += REROLE + add[given]
            to = np.take_along_axis(KEEP[codes[:, t] & 3], state, 1)
            write(new, b"I")
            cost[new] += INSERT
            state = np.where(kept, to, np.where(given | new, NEXT[state], state))
            open_ = new
            if not new.any():
                break
    while True:
        rest = last[:, None] & ((state == 1) | (state == 2))
        if not rest.any():
            break
        write(rest, b"I")
        cost[rest] += INSERT
        state = np.where(rest, NEXT[state], state)
    return state, cost, [[row.tobytes()[:k].decode() for row, k in zip(four, ks, strict=True)] for four, ks in zip(letters, filled.tolist(), strict=True)]


def _chunk_lists(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("codes")
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[i:j].astype(np.int64) for i, j in zip(offsets, offsets[1:], strict=False)]


def _groups(codes: list[np.ndarray], cells: int = 1 << 18) -> Iterator[np.ndarray]:
    """Chunks of like lengths, of a bounded number of turns, padding included."""
    order = np.argsort([len(c) for c in codes], kind="stable")
    while len(order):
        widest = np.array([len(codes[k]) for k in order])
        n = max(1, int(np.searchsorted(widest * np.arange(1, len(order) + 1), cells, "right")))
        yield order[:n]
        order = order[n:]


def _vectors(chunks: DataFrame) -> DataFrame:
    """(conv_id, chunk, behind): the cost-to-go behind each chunk, right up to a constant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _chunk_lists(batch)
            behind = np.array(batch.column("behind").to_pylist(), np.int64).reshape(-1, 4)
            before = np.zeros((len(codes), 4), np.int64)
            for own in _groups(codes):
                matrix, length = _padded([codes[k] for k in own])
                before[own] = cost_to_go(matrix, length, behind[own])
            yield arrow(
                ["conv_id", "chunk", "behind", "before"],
                [batch.column("conv_id"), batch.column("chunk"), batch.column("behind"), pa.array(before.tolist(), pa.list_(pa.int64()))],
            )

    schema = "conv_id long, chunk long, behind array<long>, before array<long>"
    end = F.array(*[F.lit(int(v)).cast("long") for v in END])
    # A conversation of one chunk needs no neighbour.
    known = chunks.where("chunks = 1").select("conv_id", "chunk", end.alias("behind"))
    long = chunks.where("chunks > 1").select("conv_id", "chunk", "codes")
    if long.isEmpty():
        return known
    now = written(long.withColumn("behind", end).mapInArrow(run, schema), "guesses")
    following = Window.partitionBy("conv_id").orderBy("chunk")
    while True:
        told = now.withColumn("told", F.lead("before").over(following))
        least = F.array_min("told")
        told = told.withColumn("told", F.transform("told", lambda v: v - least))
        wrong = F.col("told").isNotNull() & (F.col("told") != F.transform("behind", lambda v: v - F.array_min("behind")))
        told = written(told.withColumn("wrong", F.coalesce(wrong, F.lit(False))), "told")
        again = told.where("wrong").select("conv_id", "chunk", F.col("told").alias("behind"))
        if again.isEmpty():
            return known.unionByName(now.select("conv_id", "chunk", "behind"))
        again = join_same(again, long, ["conv_id", "chunk"]).select("conv_id", "chunk", "codes", "behind")
        right = told.where("not wrong").select("conv_id", "chunk", "behind", "before")
        now = written(right.unionByName(again.mapInArrow(run, schema)), "vectors")


def _traced(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per chunk: first letters' outcome for each of four entries, and illegal pairs of initials."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        legal = {(2, 0), (0, 1), (1, 0)}  # su, ua, au
        good = np.array([[(a, b) in legal for b in range(4)] for a in range(4)])
        for batch in batches:
            codes = _chunk_lists(batch)
            behind = np.array(batch.column("behind").to_pylist(), np.int64).reshape(-1, 4)
            last = batch.column("last").to_numpy(zero_copy_only=False)
            exits, costs, audits = np.zeros((len(codes), 4), np.int64), np.zeros((len(codes), 4), np.int64), [None] * len(codes)
            illegal = []
            for c, ahead in zip(codes, batch.column("initial_before").to_pylist(), strict=True):
                seen = (c if ahead is None else np.concatenate([[ahead], c])) & 3
                illegal.append(int((~good[seen[:-1], seen[1:]]).sum()))
            for own in _groups(codes):
                matrix, length = _padded([codes[k] for k in own])
                exits[own], costs[own], found = trace(matrix, length, behind[own], last[own])
                for k, four in zip(own, found, strict=True):
                    audits[k] = four
            longs = pa.list_(pa.int64())
            yield arrow(
                ["conv_id", "chunk", "exits", "costs", "audits", "illegal"],
                [batch.column("conv_id"), batch.column("chunk"), pa.array(exits.tolist(), longs),
                 pa.array(costs.tolist(), longs), pa.array(audits, pa.list_(pa.string())), pa.array(illegal, pa.int64())],
            )

    rows = join_same(chunks, vectors, ["conv_id", "chunk"])
    return rows.select("conv_id", "chunk", "codes", "behind", "last", "initial_before").mapInArrow(
        run, "conv_id long, chunk long, exits array<long>, costs array<long>, audits array<string>, illegal long"
    )


def _entered(traced: DataFrame) -> DataFrame:
    """Adds the state each chunk is entered in: the maps of the chunks before, one after the other."""
    maps = traced.select("conv_id", "chunk", "exits")
    several = maps.where("chunk > 0").select("conv_id").distinct()
    maps = join_same(maps, several, ["conv_id"])
    lists = maps.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "exits"))).alias("maps"))
    step = lambda seen, m: F.concat(seen, F.array(F.element_at(m["exits"], (F.element_at(seen, -1) + 1).cast("int"))))
    states = F.aggregate("maps", F.array(F.lit(0).cast("long")), step)
    entries = lists.select("conv_id", F.posexplode(states).alias("chunk", "entry"))
    entries = entries.select("conv_id", F.col("chunk").cast("long").alias("chunk"), "entry")
    return join_same(traced, entries, ["conv_id", "chunk"], "left").withColumn(
        "entry", F.coalesce("entry", F.lit(0)).cast("int") + 1
    )


def _hashed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's repaired turns; ``edits`` has the letters of every turn."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {2: "user", 3: "assistant"}
        key, state, at, some, letters = object(), None, 0, False, ""

        def add(line: str) -> None:
            nonlocal some
            state.update(("\n" + line if some else line).encode())
            some = True

        for batch in batches:
            ids, shas = [], []
            for conv, edit, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")], strict=True):
                if conv != key:
                    if state is not None:
                        ids.append(key)
                        shas.append(state.hexdigest())
                    key, state, at, some = conv, hashlib.sha256(), 0, False
                if edit is not None:  # goes before its turn; the last may have no turn
                    for _ in range(edit.count("I")):
                        at = int(NEXT[at])
                        add(f"{names[at]}:")
                    letters = edit
                    continue
                if letters[-1] == "K":
                    at = int(KEEP[INITIALS.find(role[:1]), at])
                    add(f"{role}:{text}")
                elif letters[-1] == "R":
                    at = int(NEXT[at])
                    add(f"{names[at]}:{text}")
            if ids:
                yield arrow(["conv_id", "sha"], [pa.array(ids, pa.int64()), shas])
        if state is not None:
            yield arrow(["conv_id", "sha"], [pa.array([key], pa.int64()), [state.hexdigest()]])

    both = edits.unionByName(rows.select("conv_id", "no", "role", "text"), allowMissingColumns=True)
    dealt = both.repartition(shuffle_width(spark), "conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", "no", F.col("edit").desc_nulls_last())
    return dealt.mapInArrow(run, "conv_id long, sha string")


def repair(turns: DataFrame, ids: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Faults, cheapest edits and the repaired text's hash of every conversation of ``ids``."""
    prepare(turns.sparkSession)
    rows = written(numbered(turns), "turns")
    text = F.col("text")
    last = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    digest = F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text").cast("binary"), 256)
    facts = rows.select(
        "conv_id", "no", "turn", digest.alias("digest"),
        F.position(F.left("role", F.lit(1)), F.lit(INITIALS)).alias("place"),
        (F.octet_length("role") == 0).alias("nameless"),
        (~text.rlike(WORD)).alias("blank"),
        (~last.isin(*".!?")).alias("cut"),
    )
    facts = written(facts, "facts")
    firsts = facts.groupBy("conv_id", "digest").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("n"))
    facts = join_same(facts, firsts.where("n > 1").drop("n"), ["conv_id", "digest"], "left")
    fault = F.when(F.col("blank"), 1).when(F.col("no") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.when((F.col("place") == 0) | F.col("nameless"), 3).otherwise(F.col("place") - 1)
    facts = written(
        facts.select(
            "conv_id", "no", "turn", fault.alias("fault"), (initial + 4 * fault).cast("int").alias("code"),
            F.floor((F.col("no") - 1) / chunk).alias("chunk"),
        ),
        "faults",
    )

    lists = facts.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("no", "code"))).alias("turns"))
    along = Window.partitionBy("conv_id").orderBy("chunk")
    lists = lists.select("conv_id", "chunk", F.col("turns.code").alias("codes"))
    chunks = written(
        lists.select(
            "conv_id", "chunk", "codes",
            F.lag(F.element_at("codes", -1)).over(along).alias("initial_before"),
            F.lead("chunk").over(along).isNull().alias("last"),
            F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("chunks"),
        ),
        "chunks",
    )
    traced = written(_traced(chunks, _vectors(chunks)), "traced")
    entered = _entered(traced)
    chosen = written(
        entered.select(
            "conv_id", "chunk", "illegal",
            F.element_at("costs", F.col("entry")).alias("cost"), F.element_at("audits", F.col("entry")).alias("audit"),
        ),
        "chosen",
    )
    # Letters of each turn, with the insertions before it; what is inserted at the end comes last.
    letters = chosen.select(
        "conv_id", (F.col("chunk") * chunk + 1).alias("from"),
        F.posexplode(F.regexp_extract_all("audit", F.lit("(I*[DKR]|I+$)"), 1)).alias("at", "edit"),
    ).select("conv_id", (F.col("from") + F.col("at")).alias("no"), "edit")
    hashes = _hashed(rows, letters)

    of = lambda k: F.count(F.when(F.col("fault") == k, 1))
    counts = facts.groupBy("conv_id").agg(of(1).alias("blank"), of(2).alias("duplicate"), of(3).alias("truncated"))
    spans = facts.where("turn is not null").groupBy("conv_id", "turn").count().groupBy("conv_id")
    spans = spans.agg(F.try_subtract(F.max("turn"), F.min("turn")).alias("span"), F.count(F.lit(1)).alias("turns"))
    spans = spans.select("conv_id", F.try_subtract("span", F.col("turns") - 1).alias("gaps"), F.lit(1).alias("spanned"))
    edits = chosen.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"),
        F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda c: c["audit"]), "").alias("audit"),
    )
    parts = ids.select(F.col("conv_id").cast("long").alias("conv_id"))
    for part in (counts, spans, edits, hashes):
        parts = parts.unionByName(part, allowMissingColumns=True)
    none = F.lit(0).cast("long")
    return parts.groupBy("conv_id").agg(
        F.when(F.max("spanned").isNull(), none).otherwise(F.max("gaps")).alias("gaps"),
        *[F.coalesce(F.max(c), none).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha"), F.lit(EMPTY)).alias("repaired_sha256"),
    )


def damage_and_repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``repair`` of the damaged table, with one row for every conversation before the damage."""
    return repair(damaged(conversations), conversations.select("conv_id"), chunk)
