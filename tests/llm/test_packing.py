import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import labels, no_docs, no_labels, odd_docs, odd_rows, table  # noqa: F401

from seqloom.llm import packing
from seqloom.llm.queries import QUERIES, tokenizer_path
from seqloom.llm.textops import slices

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(NAME))


def ids_of(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def fast():
    return packing.Encoder(tokenizer_path(NAME), remember=500)


LETTERS = "aZ'sTll déÉ×÷ßŸΣςİǅ \n\x1c\x85\xa0 1²ª!<|>endoftext中́ﬁ😀"


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=LETTERS, max_size=40), max_size=6))
def test_encoder_equals_the_tokenizer(whole, fast, texts):
    for part in slices(pa.array(texts, pa.string()), 50):
        ids, of = fast(part)
        own = texts[part.first : part.first + len(part)]
        assert [ids[i:j].tolist() for i, j in zip(of, of[1:], strict=False)] == [ids_of(whole, t) for t in own]


def test_encoder_keeps_special_tokens(whole, fast):
    text = "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|> <| don't"
    ids, _ = fast(next(slices(pa.array([text]))))
    assert ids.tolist() == ids_of(whole, text)


def check_placement(rows, capacity):
    """No overlap, no gap, nothing beyond the capacity."""
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        ends = (own.offset + own.length).tolist()
        assert [0, *ends[:-1]] == own.offset.tolist()
        assert ends[-1] <= capacity


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_runs_place_every_piece_once(counts):
    runs, opened = packing.best_fit_runs(counts, 50)
    fill = np.zeros(opened, int)
    placed = {}
    for length, rank, first, offset, count in runs.tolist():
        assert placed.get(length, 0) == rank
        placed[length] = rank + count
        for s in range(first, first + count):
            assert offset + length <= 50
            fill[s] += length
    assert placed == counts
    assert fill.sum() == sum(k * n for k, n in counts.items())
    assert opened <= best_fit(counts, 50)


def best_fit(counts, capacity):
    """Sequences that one-by-one best fit of decreasing lengths opens."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            gap = min(fits) if fits else capacity
            if fits:
                gaps.remove(gap)
            gaps.append(gap - length)
    return len(gaps)


def test_pieces_equal_the_tokenizer(spark, whole):
    docs = table(spark, "documents", "0.001")
    got = QUERIES["op1_best_fit_packing"](spark, "/root/testdata/sf0.001").toPandas()
    check_placement(got, 2048)
    want = {}
    for r in docs.collect():
        ids = [*ids_of(whole, r["text"]), 0]
        for k in range(0, len(ids), 2048):
            raw = np.array(ids[k : k + 2048], "<u4").tobytes()
            want[r["doc_id"], k // 2048] = (k, len(raw) // 4, zlib.crc32(raw))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    tokens = got.length.sum()
    assert got.sequence_id.nunique() <= -(-tokens // 2048) * 1.02 + 1


def test_rows_nobody_likes(odd_docs, odd_rows, no_docs, whole):
    got = packing.pack_documents(odd_docs, tokenizer_path(NAME), 512, with_ids=True).toPandas()
    check_placement(got, 512)
    assert got.length.sum() == sum(len(ids_of(whole, r[1])) + 1 for r in odd_rows)
    assert (got[got.doc_id == 1].length == 1).all()
    assert (got[got.doc_id == 5].piece == 0).sum() == 2
    joined = got[got.doc_id == 4].sort_values("piece").ids.map(bytes).sum()
    long = next(r[1] for r in odd_rows if r[0] == 4)
    assert np.frombuffer(joined, "<u4").tolist() == [*ids_of(whole, long), 0]
    assert packing.pack_documents(no_docs, tokenizer_path(NAME)).count() == 0
