import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rillet.llm import piece_codec as c

TEXTS = [
    "",
    None,
    " ",
    "  two  spaces ",
    "Hello world, this is a test.",
    "naïve café über straße ñandú 漢字 😀 á",
    "tabs\tand\nnew lines\r\n",
    "x" * 300,
    "internationalization" * 20 + " " + "ß" * 70,
    "mixed 123 4567 <0x41> <s> </s>",
    "\x00\x07 control",
]


@pytest.fixture(scope="module")
def codec():
    return c.codec(c.model_path())


@pytest.fixture(scope="module")
def library():
    """The library's own Viterbi: the same vocabulary marked as a unigram model."""
    import sentencepiece

    raw = open(c.model_path(), "rb").read()
    at = raw.rindex(b"tok_v0") + len(b"tok_v0")
    assert raw[at : at + 2] == b"\x18\x02"
    return sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2 :])


def random_texts(n):
    rng = random.Random(5)
    letters = "abcdefghij ▁éüñ漢.,!?-" .replace("▁", "") + "etaoin " * 3
    return ["".join(rng.choices(letters, k=rng.randint(0, 120))) for _ in range(n)]


def brute(codec, text):
    """Viterbi over the whole text, without a window."""
    s = (c.MARK + text.replace(" ", c.MARK)) if text else ""
    best, back = [0.0], [None]
    for j in range(1, len(s) + 1):
        score, origin = None, None
        for i in range(max(0, j - codec.longest), j):
            piece = codec.table.get(s[i:j])
            if piece is None and j - i > 1:
                continue
            ids, own = ([piece[0]], piece[1]) if piece else (list(codec._bytes_of(s[i])), codec.unknown)
            total = best[i] + own
            if score is None or total > score:
                score, origin = total, (i, ids)
        best.append(score)
        back.append(origin)
    out, j = [], len(s)
    while j:
        j, ids = back[j]
        out = ids + out
    return out


def test_stream_and_batch_equal_whole_viterbi(codec):
    texts = [t for t in TEXTS if t is not None] + random_texts(150)
    ids, counts = codec.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts, strict=True):
        want = brute(codec, text)
        assert ids[end - n : end].tolist() == want, text
        assert codec.encode_text(text) == want, text


def test_equals_the_library_on_ordinary_texts(codec, library):
    # Without bytes and double spaces, whose scores of -1e9 the library's 32-bit sums can't hold.
    rng = random.Random(6)
    texts = [TEXTS[4]] + [" ".join("".join(rng.choices("etaoinshrdlué.,", k=rng.randint(1, 14))) for _ in range(40)) for _ in range(100)]
    for text in texts:
        assert codec.encode_text(text) == library.encode(text), text


def test_stream_commits_before_its_end_and_keeps_a_window(codec):
    text = c.MARK + "internationalization" * 400
    parts = list(codec.stream(text))
    assert len(parts) > 100 and max(map(len, parts)) < 100
    assert [i for p in parts for i in p] == brute(codec, text[1:])


def test_round_trip_and_digest(spark, codec):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS + random_texts(40))] + [(None, "a", 1), (3, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = c.decode(c.encode(df))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, back.collect()), key=key) == sorted(((i, t or "") for i, t, _ in rows), key=key)
    digest = {(r["doc_id"], r["n_ids"], r["ids_crc32"], r["round_trip"]) for r in c.digest(df).collect()}
    want = set()
    for i, t, _ in rows:
        ids = brute(codec, t or "")
        want.add((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    assert digest == want


def test_literal_mark_comes_back_as_a_space(spark):
    df = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    assert c.decode(c.encode(df)).first()["text"] == "a b"
    assert c.digest(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, c.decode(none).collect())) == [(1, None), (2, "")]
