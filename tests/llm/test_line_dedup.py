import hashlib
import string

import numpy as np
import pytest

from rillet.llm import line_dedup as t

SCHEMA = "doc_id long, text string, a long, shard string, n_lines int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, chars=20, documents=3):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (text or "").split("\n")] for _, text, *_ in rows]
    holders = {}
    for (doc_id, *_), own in zip(rows, keys, strict=True):
        for key in {k for k in own if len(k) >= chars}:
            holders.setdefault(key, []).append(doc_id)
    out = []
    for (doc_id, text, *_), own in zip(rows, keys, strict=True):
        lines, kept = (text or "").split("\n"), []
        for line, key in zip(lines, own, strict=True):
            who = holders.get(key, [])
            ids = [x for x in who if x is not None]
            if len(who) < documents or not ids or doc_id == max(ids):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted(map(tuple, t.digest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def row(doc_id, text):
    return (doc_id, text, 7, "x", 1)


COMMON = "This line stands in many documents."
UMLAUTS = "ÄÖÜäöüßÄÖÜäöüßÄÖÜäö"  # 19 code points, 38 bytes


def corpus(n=60):
    rng = np.random.default_rng(3)
    lines = [f"A passage number {i} of the corpus" for i in range(40)] + ["short", "", "  ", UMLAUTS, UMLAUTS + "z", COMMON]
    rows = [row(int(i), "\n".join(rng.choice(lines, int(rng.integers(1, 12))))) for i in range(n)]
    rows += [row(None, COMMON), row(None, f"{COMMON}\n{COMMON}"), row(5, None), row(6, ""), row(59, f" \t{COMMON.upper()}\x0b\nown")]
    return rows + [row(7, "\n"), rows[3], rows[3], row(8, COMMON + "\r\n" + "word " * 200_000), row(-4, "word " * 200_000 + "\n\n")]


def test_equals_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_lines_sent_to_shards_give_the_same(spark, monkeypatch):
    """Several shards beyond the broadcast bound, several cells for each."""
    rows = corpus()
    monkeypatch.setattr(t, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(t, "SHARD_KEYS", 10)
    monkeypatch.setattr(t, "CELL_ROWS", 5)
    assert got(spark, rows) == brute(rows)
    monkeypatch.setattr(t, "BROADCAST_BYTES", 1 << 30)
    assert got(spark, rows) == brute(rows)


def test_null_ids_alone_keep_and_threshold(spark):
    rows = [row(None, COMMON)] * 3
    assert got(spark, rows) == brute(rows) and all(r[2] == 0 for r in got(spark, rows))
    rows = [row(i, COMMON) for i in range(2)]
    assert all(r[2] == 0 for r in got(spark, rows))
    rows = [row(1, COMMON), row(9, COMMON + "\n" + COMMON), row(9, COMMON), row(3, COMMON)]
    assert {(r[0], r[2]) for r in got(spark, rows)} == {(1, 1), (9, 0), (3, 1)}


def test_empty_table_and_no_repeats(spark):
    assert got(spark, []) == []
    rows = [row(i, f"line {i} is not repeated anywhere") for i in range(4)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 63, 5000])
def test_perfect_hash_is_minimal_and_strangers_are_told(n):
    rng = np.random.default_rng(n)
    pairs = rng.integers(0, 1 << 63, (n, 2), dtype=np.int64).astype(np.uint64)
    pairs[: n // 2, 0] = pairs[0, 0]  # the same first half
    index = t.MinimalPerfectHash.build(pairs)
    assert sorted(index.number(pairs).tolist()) == list(range(n))
    shard = t.Shard.load(t.Shard.build(pairs, np.arange(1, n + 1), np.arange(n) * 3).dump())
    counts, largest = shard.probe(pairs)
    assert counts.tolist() == list(range(1, n + 1)) and largest.tolist() == [3 * i for i in range(n)]
    strangers = rng.integers(0, 1 << 63, (1000, 2), dtype=np.int64).astype(np.uint64)
    assert not shard.probe(strangers)[0].any()
