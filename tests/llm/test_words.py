import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rillet.llm.words import ALNUM, LETTER, NOT_SPACE, PUNCTUATION, IdCache, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text("aAbZ09é '.\t\n\x0b!|漢", max_size=30)), max_size=8)


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _listed(words):
    texts = [words.data[s:e].tobytes().decode() for s, e in zip(words.start, words.end, strict=True)]
    return [texts[a : a + n] for a, n in zip(words.first, words.counts, strict=True)]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_the_regex_matches(texts):
    for kind, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = _listed(words_of(pa.array(texts, pa.string()), kind))
        assert got == [re.findall(pattern, _lower(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_equal_words_have_equal_hashes_and_others_differ(texts):
    words = words_of(pa.array(texts, pa.string()))
    flat = [w for t in _listed(words) for w in t]
    assert len(set(zip(flat, words.hashes().tolist(), strict=True))) == len(set(flat)) == len(set(words.hashes().tolist()))


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_cut_words_join_to_whole_words(texts):
    column = pa.array(texts, pa.string())
    whole = _listed(words_of(column))
    cut = _listed(words_of(column, cut=[(LETTER, PUNCTUATION), (PUNCTUATION, LETTER)]))
    assert ["".join(t) for t in whole] == ["".join(t) for t in cut]
    for words in cut:
        assert not any(re.search(r"[a-z][!|.]|[!|.][a-z]", w) for w in words)


def test_cache_gives_the_same_ids_when_it_forgets():
    texts = pa.array(["a b a", "", None, "b c", "a"])
    learn = lambda words: [list(w) + [len(w)] for w in words]
    for limit in (0, 100):
        cache = IdCache(learn, limit)
        for _ in range(2):
            ids, counts = cache.encode(words_of(texts))
            assert counts.tolist() == [6, 0, 0, 4, 2]
            assert ids.tolist() == [97, 1, 98, 1, 97, 1, 98, 1, 99, 1, 97, 1]


def test_slices_and_no_rows():
    column = pa.array(["x y", "z", None, "w v u"]).slice(1, 3)
    assert _listed(words_of(column)) == [["z"], [], ["w", "v", "u"]]
    empty = words_of(pa.array([], pa.string()))
    assert empty.n == 0 and len(empty.hashes()) == 0 and isinstance(empty.first, np.ndarray)
