import random
import re

import pytest

from rillet.llm import near_dedup
from rillet.llm.components import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def got(spark, rows, k, percent):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, component_id int, a int")
    return sorted(map(tuple, near_dedup.near_duplicates(df, k, percent).collect()))


def corpus(seed, n_base=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(rng.choices(words, k=40))
    for _ in range(n_base):
        text = rng.choices(words, k=rng.randint(1, 120))
        rows.append(" ".join(text))
        for _ in range(rng.randint(0, 4)):  # near copies around the threshold, and chains of them
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text) if rng.random() < 0.7 else " ".join(text).upper())
    rows += [passage + " " + " ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(15)]
    rows += [None, "", "  ", "one", "One", "one two", "one two", "漢字 é", "漢字 É"]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_equals_brute_force(spark, seed, k, percent):
    rows = corpus(seed)
    assert got(spark, rows, k, percent) == brute(rows, k, percent)


def test_large_group_of_near_copies_and_far_heads(spark):
    # Many copies that differ in one word each, some of them far from the smallest id.
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(1 + i % 6):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rows[0] = (0, " ".join(base[:90] + [f"y{i}" for i in range(60)]))
    assert got(spark, rows, 3, 85) == brute(rows, 3, 85)


def family(n, changed, seed=7):
    """Copies of 40 words with one word changed: similar to each other, linked where it is the same word."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        text = list(base)
        text[rng.randrange(changed)] = f"x{i}"
        rows.append((i, " ".join(text)))
    return rows


def test_crowd_of_similar_copies_lists_no_pairs(spark, monkeypatch):
    """Several blocks a family: what comes out joins components (all pairs would be 11,175 and 44,850)."""
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 100)
    made = []
    joining = near_dedup.staged

    def seen(df, label):
        out = joining(df, label)
        if label in ("across", "joining"):
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "staged", seen)
    for n in (150, 300):
        made.clear()
        rows = family(n, 40)
        assert got(spark, rows, 3, 85) == brute(rows, 3, 85)
        assert sum(made) <= 6 * n


def test_no_rows_null_ids_and_repeated_rows(spark):
    assert got(spark, [], 3, 85) == []
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, None)]
    assert got(spark, rows, 3, 85) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_null_and_repeated_ids_lose_no_text(spark):
    import corpus_pipeline

    texts = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcd"}
    # One id with two texts, one of them a copy of a smaller id's; texts without an id.
    rows = [(1, texts["a"]), (5, texts["a"]), (5, texts["b"]), (None, texts["c"]), (None, texts["c"] + " x"), (None, texts["d"]), (7, texts["d"])]
    rows += [(None, texts["c"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert (1, texts["a"]) in kept and (5, texts["b"]) in kept and (7, texts["d"]) in kept and len(kept) == 4
    assert sum(i is None and t.startswith(texts["c"]) for i, t in kept) == 1
    # The query has a row for each, as its SQL does.
    found = near_dedup.digest(df).collect()
    none = [r["n_shingles"] for r in found if r["doc_id"] is None and r["component_id"] is None]
    assert len(found) == len(rows) and sorted(none) == [38, 38, 38, 39]


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges += [(5, 5), (300, 301), (301, 300)]
    rng.shuffle(edges)
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200 + i: 200 for i in range(9)} | {300: 300, 301: 300}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
