import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rillet.llm import pitman_yor as y
from rillet.llm.words import words_of


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def corpus():
    rng = np.random.default_rng(7)
    words = ["the", "of", "a", "über", "cat", "dog", "runs", "fast", "漢"] + [f"w{i}" for i in range(40)]
    p = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, size=rng.integers(0, 60), p=p / p.sum())) for _ in range(80)]
    texts = [t.title() if i % 5 == 0 else t for i, t in enumerate(texts)]
    return [*enumerate(texts), (900, None), (901, ""), (902, " \t "), (903, "unseen wörd zzz" * 3), (904, "w " * 3000)]


def test_base_columns_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in y.digest(df).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not out[i] for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows) and any(out.values())
    for i, t in rows:
        tokens, r = tokens_of(t), got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[i], len(tokens), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_ngrams_of_symbols():
    grams, tokens, sizes, n = y.symbols_of(pa.array(["Ab c", None, ""]))
    assert n.tolist() == [3, 1, 1] and sizes.tolist() == [3, 2, 1, 1, 1]
    flat = [*b"\xfe\xfe\xfe\xfeab c \xff"]
    want = [int.from_bytes(bytes(flat[i : i + 5])) for i in range(len(flat) - 4)]
    end = int.from_bytes(b"\xfe\xfe\xfe\xfe\xff")
    assert grams.tolist() == [*want, end, end]
    assert tokens[2] == tokens[3] == tokens[4] == y.END_TOKEN and tokens[0] != tokens[1]


def test_history():
    at, earlier, distinct = y.history(np.array([5, 6, 5, 5, 6, 5, 7]), np.array([4, 3]))
    assert at.tolist() == [0, 1, 2, 3, 0, 1, 2]
    assert earlier.tolist() == [0, 0, 1, 2, 0, 0, 0]
    assert distinct.tolist() == [0, 1, 2, 2, 0, 1, 2]


def test_history_equals_counting():
    rng = np.random.default_rng(5)
    n_tokens = rng.integers(1, 30, 50)
    tokens = rng.choice(np.array([y.END_TOKEN, -5, -(2**63), -(2**40), -7]), n_tokens.sum())
    want = []
    for text in np.split(tokens, np.cumsum(n_tokens)[:-1]):
        want += [(i, int((text[:i] == t).sum()), len(set(text[:i]))) for i, t in enumerate(text)]
    assert np.array_equal(np.stack(y.history(tokens, n_tokens), axis=1), want)


def test_symbols_of_odd_texts():
    odd = ["", None, " \t\n", "\x00a", "a\x00", "\x00" * 2, "aB\r\nc\x1fd\x85", "  é漢😀 ", "12345678 123456789", "x" * 70 + " " + "x" * 71, "A"]
    for texts in (odd, odd[::-1], odd * 3, ["a"], [None]):
        grams, keys, sizes, n = y.symbols_of(pa.array(texts, pa.string()))
        want, all_tokens = [], []
        for text in texts:
            tokens = tokens_of(text)
            flat = b"\xfe" * 4 + b"".join(b"\xff" if t is None else t.encode() + b" " for t in tokens)
            want += [int.from_bytes(flat[i - 4 : i + 1], "big") for i in range(4, len(flat))]
            all_tokens += tokens
        assert grams.tolist() == want
        assert sizes.tolist() == [1 if t is None else len(t.encode()) + 1 for t in all_tokens]
        assert n.tolist() == [len(tokens_of(t)) for t in texts]
        assert (keys < 0).all() and len({*zip(all_tokens, keys.tolist())}) == len(set(all_tokens)) == len(set(keys.tolist()))
    assert [len(x) for x in y.symbols_of(pa.array([], pa.string()))] == [0, 0, 0, 0]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 70_000])
def test_values_are_found_by_key(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 40, n), rng.integers(-(1 << 63), 0, n), np.arange(n)]))
    values = rng.random(len(keys))
    by_key = dict(zip(keys.tolist(), values))
    order = rng.permutation(len(keys))
    wanted = np.concatenate([keys[order], keys[:50] + 1, [0, -1, 1 << 62]]).astype(np.int64)
    got = y.Values(keys[order], values[order]).of(wanted)
    assert got.tolist() == [by_key.get(k, 0.0) for k in wanted.tolist()]


def test_symbols_and_answers_cost_less_than_plain_ones():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshrdlu"), size=rng.integers(1, 10))) for _ in range(20_000)]
    texts = pa.array([" ".join(rng.choice(words, size=1500)) for _ in range(100)])
    grams = y.symbols_of(texts)[0]
    keys = np.unique(np.concatenate([grams, rng.integers(0, 1 << 40, 400_000)]))
    values = y.Values(keys, keys.astype(float))

    def cost(run):
        times = []
        for _ in range(5):
            start = time.process_time()
            run()
            times.append(time.process_time() - start)
        return min(times)

    assert cost(lambda: y.symbols_of(texts)) < cost(lambda: words_of(texts).hashes())
    assert cost(lambda: values.of(grams)) < 0.7 * cost(lambda: np.searchsorted(keys, grams))


def grams_of(texts):
    grams = y.symbols_of(pa.array(texts))[0]
    return np.unique(grams, return_counts=True)


def test_predictive_probabilities_sum_to_one():
    keys, n = grams_of(["the cat and the dog and the cat again"] * 3)
    context = keys[0] >> 8
    every = np.unique(np.concatenate([keys, (context << 8) + np.arange(256)]))
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, keys)] = n
    uniform = lambda k: np.full(len(k), 1 / 256)
    p, _ = y.sample(every, counts, y.ORDER, 1, uniform, 3)
    assert p[every >> 8 == context].sum() == pytest.approx(1, abs=1e-9)
    table = y.upper({int(k): 3 for k in np.unique(keys & 0xFFFF)}, 5)
    assert np.allclose(table.sum(axis=1), 1)


def test_seating_stays_consistent():
    rng = np.random.default_rng(1)
    keys, n = grams_of(["a b a b c a b", "abcabc abc", "b a"] * 20)
    level = y.Restaurants(keys, y.ORDER, rng)
    level.start(n)
    parent = np.full(len(keys), 1e-2)
    total = n.copy()
    tables = level.tables.copy()
    for _ in range(30):
        tables += level.reseat(parent)
        assert np.array_equal(level.customers, total)
        assert np.array_equal(level.tables, tables) and (level.tables <= level.customers).all()
        assert np.array_equal(np.bincount(level.at, level.size, len(keys)), total) and (level.size > 0).all()
        assert (np.diff(level.at) >= 0).all()
    assert tables.sum() > len(keys)  # some dishes got more tables
    change = np.where(total > 2, -1, 1)
    tables += level.follow(change, parent)
    assert np.array_equal(level.customers, total + change) and np.array_equal(level.tables, tables)


def test_sampled_number_of_tables_is_that_of_the_process(monkeypatch):
    # One dish with two customers: P(two tables) from the restaurant's own rule.
    monkeypatch.setattr(y, "DISCOUNT", (0.5,) * 5)
    monkeypatch.setattr(y, "STRENGTH", (1.0,) * 5)
    keys = np.arange(0, 4000 << 8, 256, dtype=np.int64)  # 4000 contexts with one dish each
    level = y.Restaurants(keys, 1, np.random.default_rng(2))
    level.start(np.full(len(keys), 2))
    parent, share = np.full(len(keys), 0.3), []
    for i in range(40):
        level.reseat(parent)
        if i >= 10:
            share.append((level.tables == 2).mean())
    # After the other customer sits alone: new (1 + .5) * .3, joins 1 - .5.
    assert np.mean(share) == pytest.approx(0.45 / 0.95, abs=0.02)


def counted(c, discount):
    """Weights of c customers at 0..c tables, by seating one after the other."""
    ways = [0.0, 1.0]
    for n in range(1, c):
        ways = [0.0] + [ways[t - 1] + (n - t * discount) * (ways[t] if t < len(ways) else 0) for t in range(1, n + 2)]
    return np.array(ways)


@pytest.mark.parametrize(("c", "x"), [(9, 0.7), (60, 3.0), (60, 200.0), (150, 12.0)])
def test_numbers_of_tables_have_the_weights_of_all_seatings(c, x):
    n = 20_000
    t = np.ones(n, np.int64)
    for _ in range(12):
        t = y.draw_tables(np.full(n, c), t, np.full(n, x), 0.8, np.random.default_rng(len(t) + int(t.sum())))
    want = counted(c, 0.8) * x ** np.arange(c + 1.0)
    share = np.bincount(t, minlength=c + 1) / n
    assert np.abs(share - want / want.sum()).max() < 0.015


@pytest.mark.parametrize("discount", y.DISCOUNT)
def test_expansion_and_saddle_point_equal_the_recursion(monkeypatch, discount):
    t = np.arange(1, 250)
    c = np.full(len(t), 256)
    want = y.log_ways(c, t, discount)
    monkeypatch.setattr(y, "COUNTED", 255)
    y._counted.cache_clear()
    got = y.log_ways(c, t, discount)
    y._counted.cache_clear()
    assert np.abs(np.diff(got) - np.diff(want)).max() < 0.05


def test_a_sweep_moves_every_customer_of_a_frequent_dish():
    # A context with 256 dishes; the parent holds the frequent one for as likely as all the others.
    keys = np.arange(256, dtype=np.int64)
    level = y.Restaurants(keys, 5, np.random.default_rng(4))
    level.start(np.where(keys == 7, 1_000_000, 5))
    parent = np.where(keys == 7, 0.5, 0.5 / 255)
    for _ in range(8):
        level.reseat(parent)
    assert level.tables[7] > 50 and level.customers[7] == 1_000_000


def test_sweeps_have_the_seatings_of_children_and_parent():
    # 4000 parents alike, each over two contexts; every state's weight from the restaurants' own rules.
    customers, copies = {(1, 7): 4, (1, 8): 2, (2, 7): 3}, 4000
    keys = np.array(sorted(a << 24 | b << 8 | w for a, w in customers for b in range(copies)))
    rng = np.random.default_rng(11)
    child, parent = y.Restaurants(keys, 4, rng), None
    up_keys, up = np.unique(keys & 0xFFFFFF, return_inverse=True)
    parent = y.Restaurants(up_keys, 3, rng)
    child.start(np.array([customers[int(k) >> 24, int(k) & 0xFF] for k in keys]))
    parent.start(np.bincount(up, child.tables).astype(np.int64))
    base = np.full(len(up_keys), 0.4)

    def opened(tables, discount, strength):
        return math.prod(strength + discount * i for i in range(1, tables))

    d, e, s, r = y.DISCOUNT[3], y.DISCOUNT[2], y.STRENGTH[3], y.STRENGTH[2]
    want = Counter()
    for t in itertools.product(range(1, 5), range(1, 3), range(1, 4)):
        at = math.prod(counted(c, d)[k] for c, k in zip(customers.values(), t)) * opened(t[0] + t[1], d, s) * opened(t[2], d, s)
        c7, c8 = t[0] + t[2], t[1]
        for t7, t8 in itertools.product(range(1, c7 + 1), range(1, c8 + 1)):
            above = counted(c7, e)[t7] * counted(c8, e)[t8] * opened(t7 + t8, e, r) * 0.4 ** (t7 + t8)
            want[*t, t7, t8] = at * above / math.prod(r + i for i in range(1, c7 + c8))
    got = Counter()
    for i in range(60):
        y.sweep([child, parent], [up], base)
        assert np.array_equal(parent.customers, np.bincount(up, child.tables))
        if i >= 20:
            of = {k: child.tables[(keys >> 24 == k[0]) & (keys & 0xFF == k[1])] for k in customers}
            got.update(zip(*(of[k].tolist() for k in customers), *(parent.tables[up_keys & 0xFF == w].tolist() for w in (7, 8))))
    total, n = sum(want.values()), sum(got.values())
    assert max(abs(got[k] / n - want[k] / total) for k in want) < 0.006 and set(got) <= set(want)


def test_drawn_measures_have_the_mean_and_spread_of_the_process():
    # Four symbols and 3000 contexts alike; without customers the variance is p (1 - p) (1 - discount) / (1 + strength).
    keys = np.array([c << 8 | w for c in range(3000) for w in range(4)])
    parent = np.tile([0.1, 0.2, 0.3, 0.4], 3000)
    level = y.Restaurants(keys, 2, np.random.default_rng(5))
    level.start(np.zeros(len(keys), np.int64))
    drawn = level.measure(parent).reshape(-1, 4)
    p = parent[:4]
    assert np.allclose(drawn.sum(axis=1), 1) and np.abs(drawn.mean(axis=0) - p).max() < 0.03
    assert np.abs(drawn.var(axis=0) / (p * (1 - p) * (1 - level.discount) / (1 + level.strength)) - 1).max() < 0.12
    level.start(np.tile([30, 0, 5, 0], 3000))
    drawn = level.measure(parent).reshape(-1, 4)
    assert np.abs(drawn.mean(axis=0) - level.predictive(parent)[:4]).max() < 0.01


@pytest.mark.parametrize("discount", y.DISCOUNT)
def test_seatings_of_many_customers_go_on_from_those_of_few(discount):
    c, t = np.repeat([255, 256, 257, 258], 4), np.tile([1, 4, 60, 200], 4)
    step = np.diff(y.log_seatings(c, t, discount).reshape(4, 4), axis=0)
    assert np.abs(step - step[0]).max() < 0.05
    assert np.isneginf(y.log_seatings(np.array([3, 300]), np.array([4, 301]), discount)).all()


def test_scores_tell_the_language_from_noise(spark):
    rng = np.random.default_rng(9)
    # Each text keeps to one of four vocabularies, which its own restaurant finds out.
    words = ["".join(rng.choice(list("etaoin"), size=4)) for _ in range(240)]
    rows = [(i, " ".join(rng.choice(words[i % 4 * 60 :][:60], size=300))) for i in range(60)]
    rows += [(1000 + i, " ".join("".join(rng.choice(list("qxzjkv#9"), size=4)) for _ in range(50))) for i in range(60) if zlib.crc32(str(1000 + i).encode()) % 7 == 2]
    got = y.digest(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    held = got[got.held_out & (got.doc_id < 1000)]
    noise = got[got.doc_id >= 1000]
    assert len(held) and len(noise)
    assert (held.score / held.n_tokens).min() > (noise.score / noise.n_tokens).max() + 1
    assert held.score.sum() > held.base_score.sum()


def test_no_rows_null_ids_and_no_training_rows(spark):
    schema = "doc_id long, text string"
    assert y.digest(spark.createDataFrame([], schema)).count() == 0
    got = y.digest(spark.createDataFrame([(None, "a b"), (None, "a b")], schema)).collect()
    assert len(got) == 2 and not got[0]["held_out"] and got[0]["score"] == got[1]["score"]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = y.digest(spark.createDataFrame([(held, "a b")], schema)).first()
    assert only["train_tokens"] == 0 and only["base_score"] == 0 and math.isfinite(only["score"])


def seated_one_by_one(tokens, n_tokens, parent):
    out, i = [], 0
    for n in n_tokens:
        customers, tables = Counter(), Counter()
        for at in range(n):
            w, c = tokens[i], customers[tokens[i]]
            out.append((at, c, tables[w], sum(tables.values())))
            new = (y.TEXT_STRENGTH + y.TEXT_DISCOUNT * sum(tables.values())) * parent[i]
            chance = y.chance_of(tokens[i : i + 1], np.array([at]))[0]
            if not c or chance * (c - y.TEXT_DISCOUNT * tables[w] + new) < new:
                tables[w] += 1
            customers[w] += 1
            i += 1
    return out


def test_a_text_is_seated_word_after_word():
    rng = np.random.default_rng(12)
    n_tokens = rng.integers(1, 200, 60)
    tokens = rng.choice(np.array([y.END_TOKEN, *range(-20, -2)]), n_tokens.sum(), p=1 / np.arange(1, 20) / (1 / np.arange(1, 20)).sum())
    parent = rng.choice([1e-6, 1e-3, 0.01, 0.2], len(tokens))
    got = np.stack(y.seat(tokens, n_tokens, parent), axis=1)
    assert got.tolist() == [list(map(int, x)) for x in seated_one_by_one(tokens, n_tokens, parent)]
    assert (got[:, 2] > 1).sum() > 100  # words with several tables


def test_chances_are_even():
    u = y.chance_of(np.arange(-100_000, 0), np.arange(100_000) % 50)
    assert abs(u.mean() - 0.5) < 0.005 and 0 <= u.min() and u.max() < 1 and abs(np.mean(u < 0.1) - 0.1) < 0.005


def test_words_tables_have_the_weights_of_their_restaurant(spark):
    """Words alike in one restaurant: the sampled state solves tables = what the process gives with that mass."""
    copies, customers, base, alone = 6000, 5, 1e-4, 500
    rows = [(-i - 2, customers, base) for i in range(copies)]
    got = y.word_tables(spark.createDataFrame(rows, "key long, n long, base double"), alone, 3).toPandas()
    assert len(got) == copies and (got.n == customers).all() and got.tables.between(1, customers).all()
    mass = y.WORD_STRENGTH / y.WORD_DISCOUNT + alone + got.tables.sum()
    weight = counted(customers, y.WORD_DISCOUNT) * (y.WORD_DISCOUNT * mass * base) ** np.arange(customers + 1.0)
    want = (weight * np.arange(customers + 1)).sum() / weight.sum()
    assert got.tables.mean() == pytest.approx(want, abs=0.05) and want > 1.2


def test_spellings_of_words(spark):
    texts = ["ab cd ab", "x ab", None, "", "longer words, ünlike others", "ab"]
    grams, tokens, sizes, n = y.symbols_of(pa.array(texts))
    seen = {}
    for t, own in zip(tokens.tolist(), np.split(grams, np.cumsum(sizes)[:-1])):
        seen.setdefault(t, []).append(own.tolist())
    docs = spark.createDataFrame([(t or "", False) for t in texts] + [("zz ab", True)], "text string, held_out boolean")
    got = {r["key"]: r for r in y.counts(docs).collect()}
    assert {k: r["n"] for k, r in got.items() if k < 0} == {k: len(v) for k, v in seen.items()}
    for key, r in got.items():
        if key >= 0:
            assert r["spelling"] is None
            continue
        own, size = y.grams_of_spellings(pa.array([bytes(r["spelling"])]))
        assert own.tolist() in seen[key] and size.tolist() == [len(own)]
    held = y.symbols_of(pa.array(["zz ab"]))[0].tolist()
    assert {k for k in got if k >= 0} == {*grams.tolist(), *held}


def test_score_seats_training_words_and_the_texts_own(spark, monkeypatch):
    """Score of a text by hand: every symbol is 1/256, so only the words' restaurants matter."""
    monkeypatch.setattr(y, "probabilities", lambda grams, groups: grams.select("key", y.F.lit(math.log10(1 / 256)).alias("p")))
    rows = [(i, " ".join(["aa"] * 30 + ["b"] * (i % 3))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens_of(t))
    base = {"aa": 256.0**-3, "b": 256.0**-2, None: 256.0**-1}
    listed = y.word_tables(spark.createDataFrame([(-k - 2, n, base[w]) for k, (w, n) in enumerate(train.items())], "key long, n long, base double"), 0, 13)
    tables = {w: r["tables"] for (w, n), r in zip(train.items(), sorted(listed.collect(), key=lambda r: -r["key"]), strict=True)}
    assert tables[None] >= 1 and sum(tables.values()) < 12
    got = {r["doc_id"]: r["score"] for r in y.score(docs).collect()}
    for i, t in rows:
        keys, n_tokens = y.symbols_of(pa.array([t]))[1], np.array([len(tokens_of(t))])
        new = y.WORD_STRENGTH + y.WORD_DISCOUNT * sum(tables.values())
        p = np.array([(train[w] - y.WORD_DISCOUNT * tables[w] + new * base[w]) / (y.WORD_STRENGTH + train.total()) for w in tokens_of(t)])
        seated = seated_one_by_one(keys, n_tokens, p)
        want = sum(math.log10((c - 0.9 * own + (300 + 0.9 * all_) * p[at]) / (300 + at)) for at, c, own, all_ in seated)
        assert got[i] == pytest.approx(want, abs=0.2)  # the words' few tables are sampled
        assert max(own for _, _, own, _ in seated) > 5  # a word of the text has many


def test_a_frequent_word_has_more_tables_than_one(spark):
    words = [(-2, 1600, 1e-2), *((-3 - i, 2, 1e-9) for i in range(200))]
    tables = {r["key"]: r["tables"] for r in y.word_tables(spark.createDataFrame(words, "key long, n long, base double"), 0, 1).collect()}
    assert tables[-2] > 2 and np.mean([t for k, t in tables.items() if k < -2]) < 1.01
