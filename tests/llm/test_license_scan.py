import math
import random
import re

from rillet.llm import license_scan as s

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    own, places, labels = words(text), [], set()
    for phrase, label in s.PHRASES.items():
        want = phrase.split()
        for i in range(len(own) - len(want) + 1):
            if own[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def corpus():
    rng = random.Random(3)
    filler = ["the", "of", "is", "License", "public", "General", "all", "rights", "CC", "by", "reserved", "é漢", "x-1", "and"]
    texts = [" ".join(rng.choices(filler, k=rng.randint(0, 80))) for _ in range(60)]
    texts += [t + " " + rng.choice(ts) + " " + t for t in texts[:20] for ts in [rng.choice(list(s.TEMPLATES.values()))]]
    texts += [None, "", "...", "cc", "CC BY", "cc.by cc-by CC\nBY", "all rights reserved all rights reserved", "general public general public license"]
    texts += ["w " * 30000 + "All Rights Reserved"]
    return list(enumerate(texts))


def test_base_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_words int, place int")
    got = {r["doc_id"]: r for r in s.digest(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) >= (r["n_base"] > 0)


def label(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in s.digest(df).collect()}


def test_notices_are_found_whole_and_with_edits(spark):
    mit = s.TEMPLATES["mit"][0]
    edited = mit.replace("free of charge", "entirely free of charge").replace("copy of", "full copy of")
    bsd = s.TEMPLATES["bsd"][0]
    half = " ".join(bsd.split()[:8])
    got = label(spark, ["pre " + mit + " post", edited, bsd, half, " ".join(reversed(mit.split())), "of the license and the work"])
    assert [("mit" in got[i]["labels"]) for i in range(6)] == [True, True, False, False, False, False]
    assert "bsd" in got[2]["labels"] and "bsd" not in got[3]["labels"]
    assert got[0]["score"] == 1 and s.MIN_SHARE <= got[1]["score"] < 1 and got[4]["labels"] == ""


def test_no_rows_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, "cc by"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_base"]) for r in s.digest(df).collect())
    assert got == [(0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1)]
    assert s.digest(df.limit(0)).count() == 0


def brute_labels(text):
    """Votes by comparing all k-grams, spans by trying every window, chains by trying every earlier match."""
    own, out, top = words(text), set(), 0.0
    k = s.NOTICE_K
    for label, texts in s.TEMPLATES.items():
        for wording in texts:
            want = words(wording)
            size = len(want) - k + 1
            length = size + max(s.MERGE, math.ceil((1 - s.MIN_SHARE) * size))
            where = {}
            for t in range(size):
                where.setdefault(tuple(want[t : t + k]), []).append(t)
            points = [(p, t) for p in range(len(own) - k + 1) for t in where.get(tuple(own[p : p + k]), [])]
            group, number, last = {}, 0, None
            for d in sorted({p - t for p, t in points}):
                number += last is not None and d - last > s.MERGE
                group[d] = number
                last = d
            best = 0
            for begin in {p for p, _ in points}:
                for g in set(group.values()):
                    span = sorted(x for x in points if begin <= x[0] < begin + length and group[x[0] - x[1]] == g)
                    longest = []
                    for i, (p, t) in enumerate(span):
                        longest.append(1 + max((longest[j] for j in range(i) if span[j][0] < p and span[j][1] < t), default=0))
                    best = max([best, *longest])
            if best >= s.MIN_SHARE * size:
                out.add(label)
                top = max(top, best / size)
    return out, top


def test_labels_equal_brute_force(spark):
    rng = random.Random(9)
    short = [t for ts in s.TEMPLATES.values() for t in ts if len(t) < 200]
    texts = []
    for _ in range(60):
        own = " ".join(rng.choices(short, k=rng.randint(1, 3))).split()
        for _ in range(rng.randint(0, 8)):
            i = rng.randrange(len(own))
            own[i : i + rng.randint(0, 2)] = rng.choice([[], ["word"], own[:4], ["licensed", "under", "the"]])
            own = own or ["x"]
        texts.append(" ".join(own))
    got = label(spark, texts)
    for i, text in enumerate(texts):
        labels, share = brute_labels(text)
        assert set(filter(None, got[i]["labels"].split(","))) == labels | set(filter(None, brute(text)[4].split(","))), text
        assert got[i]["score"] == (1.0 if brute(text)[1] else share), text


def test_repeated_phrases_are_no_license(spark):
    mit = s.TEMPLATES["mit"][-1]
    texts = [
        "licensed under the " * 10,
        "licensed under the " * 50000,
        "the terms of the " * 100 + "subject to the terms of " * 100,
        mit,
        s.TEMPLATES["isc"][0].replace("THE AUTHOR", "THE OWNER"),
    ]
    got = label(spark, texts)
    assert [got[i]["labels"] for i in (0, 1, 2)] == ["", "", ""] and got[1]["score"] == 0
    assert "mit" in got[3]["labels"] and got[3]["score"] == 1
    assert "isc" in got[4]["labels"] and 0.6 <= got[4]["score"] < 1
    # Far diagonals are no span; falling positions on near ones are no chain.
    assert s.verified([(0, list(range(30))), (400, list(range(30, 60)))], 100) == 30
    assert s.verified([(0, [3]), (2, [2]), (4, [1])], 10) == 1
