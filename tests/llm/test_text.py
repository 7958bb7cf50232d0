import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from recollect.llm import _text as T
from recollect.llm.near_dup import shingle_sets

from .data import shingles, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \t\n\x0b\x1c éß漢", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    data, offsets = T.texts(pa.array(texts, pa.string()))
    low = T.LOWER[data]
    starts, ends, at = T.word_spans(data, offsets)
    got = [[low[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(at[:-1], at[1:])]
    assert got == [words(t) for t in texts]
    hashes = T.span_hashes(low, starts, ends)
    flat = [w for t in got for w in t]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    data, offsets = T.texts(pa.array(texts, pa.string()))
    _, at = shingle_sets(data, offsets, 5)
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]


def test_same_words_same_hash_in_other_places():
    a = T.texts(pa.array(["x y z w v", "q", "x y z w v u"]))
    sh, at = shingle_sets(*a, 5)
    assert set(sh[at[0] : at[1]].tolist()) <= set(sh[at[2] : at[3]].tolist())


def test_pieces_keep_documents_whole():
    data, offsets = T.texts(pa.array(["a" * 50, None, "b" * 7, "", "c" * 30]))
    assert [(i, j) for i, j, *_ in T.pieces(data, offsets, 10)] == [(0, 2), (2, 4), (4, 5)]
