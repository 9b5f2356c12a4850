import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm.textops import Hasher, char_offsets, shingles, slices, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té你\x1f", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_shingles_do_not_depend_on_slices(texts, size):
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    got, grams = [], []
    for part in slices(pa.array(texts, pa.string()), size):
        found = words(part)
        cut = [bytes(part.data[i:j]).decode() for i, j in zip(found.start, found.end, strict=True)]
        got += [cut[i:j] for i, j in zip(found.of, found.of[1:], strict=False)]
        own = Hasher(part.data)(found.start, found.end)
        gram, text = shingles(own, found.of, 3)
        grams += [gram[text == i].tolist() for i in range(len(part))]
    assert got == want
    names = {}
    for own, hashes in zip(want, grams, strict=True):
        tuples = [tuple(own[i : i + 3]) for i in range(max(len(own) - 2, min(len(own), 1)))]
        assert len(tuples) == len(hashes)
        for t, h in zip(tuples, hashes, strict=True):
            assert names.setdefault(t, h) == h
    assert len(set(names.values())) == len(names)


def test_char_offsets_count_code_points():
    data = np.frombuffer("aé你b".encode(), np.uint8)
    assert char_offsets(data, np.array([0, 1, 3, 6, 7])).tolist() == [0, 1, 2, 3, 4]
