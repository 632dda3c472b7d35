import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillet.llm import packing as p


def encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, p.END_ID] for x in texts]


def check_plan(histogram, capacity):
    fill, placed = defaultdict(list), defaultdict(list)
    for length, rank, n, sequence, offset in p.plan(histogram, capacity):
        placed[length] += range(rank, rank + n)
        for s in range(sequence, sequence + n):
            fill[s].append((offset, length))
    for length, n in histogram.items():
        assert sorted(placed[length]) == list(range(n))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(fill) == list(range(len(fill)))
    return len(fill)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_plan_places_every_piece_once(histogram):
    n = check_plan(histogram, 64)
    tokens = sum(k * v for k, v in histogram.items())
    assert n >= -(-tokens // 64)


def test_plan_pads_little():
    rng = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(50_000):
        histogram[min(2048, int(rng.lognormvariate(6, 1.2)) + 1)] += 1
    n = check_plan(dict(histogram), 2048)
    tokens = sum(k * v for k, v in histogram.items())
    assert tokens / (n * 2048) > 0.97


TEXTS = [
    "",
    None,
    "Hello, World! It's the dog's 123 4,5 x.y e.g. don't",
    "é. É, ü-ö 漢字。x é.f ≮ a…. b…c.",
    "word " * 5000,
    "a",
    " \t\n",
    "ÀÉ ﬁ Ⅷ İi ß 'S 's",
    "o'clock ''tis 'll'll 're",
]


MARKED = [
    "end <|endoftext|> next",
    "a<|endoftext|>b, C.<|startoftext|><|endoftext|>",
    "plain (text)",
    None,
    "End <|ENDOFTEXT|> next <|endof text|>",
    "<|endoftext|>",
    "word, " * 3000 + "<|endoftext|>" + " Über x.y" * 50,
    "",
]


def test_added_tokens_are_found_in_the_text(spark):
    import pyarrow as pa

    ids, counts = p.WordEncoder(p.tokenizer_path()).encode(pa.array(MARKED))
    got = [[*x.tolist(), p.END_ID] for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == encode(MARKED)
    rows = p.digest(spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")).collect()
    want = {i: (len(x), zlib.crc32(np.array(x[: p.CAPACITY], "<u4").tobytes())) for i, x in enumerate(encode(MARKED))}
    assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in rows if r["start"] == 0} == want


def test_pieces_hold_every_id_once(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices(["the", "Of", "x1.", "über,", "(a)"], k=rng.randint(0, 900))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = p.digest(df).collect()
    ids = encode(texts)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, own in enumerate(ids):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own), texts[i]
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own), texts[i]
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= p.CAPACITY


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a b"), (1, "a b"), (1, "a c"), (None, "a b")]])
def test_no_rows_null_ids_and_repeated_rows(spark, rows):
    out = p.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(rows)
