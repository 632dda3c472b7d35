import hashlib
import random
import re
import time

import pytest

from rillet.llm import pii

KEY = "AKIA" + "QZ7M2K9XW4TB8RNP"
TOKEN = "3f9a0c7be1d24586a7f03e9b1c5d8246f0e7a913"
TEXTS = [
    None,
    "",
    "plain text without anything 12 3.4 a@b",
    "mail a.b+c@x-y.example.com, and é漢 z@q.org.",
    "ips 1.2.3.4 256.1.1.1 1.2.3.4.5 0001.2.3.4 99999999999.1.1.1",
    "cards 4111 1111 1111 1111 and 4111-1111-1111-1112 and 378282246310005 x",
    "phone +1 (619) 555-0053 and +44 20 7946 0958 or +123 and +1234567890123456",
    "4111111111111111@x.com +4111111111111111",
    f"token = \"{TOKEN}\" password=hunter2abc99XY88 {KEY} end",
    "ssn 123-45-6789 and IBAN DE89 3704 0044 0532 0130 00 ok",
    "x" * 50000 + " me@here.net " + "1 " * 2000,
]


def brute(text):
    """Spans by the patterns alone, each kind over the whole text."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        check = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and check % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def frame(spark, texts):
    many = [(i, t, "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(many, "doc_id long, text string, spans string, n_chars long")


@pytest.fixture(scope="module")
def found(spark):
    # Repeated, so that the classifier has something to learn from.
    return {r["doc_id"]: r for r in pii.digest(frame(spark, TEXTS * 8)).collect()}


def test_base_equals_brute_force(found):
    assert len(found) == 8 * len(TEXTS)
    for i, text in enumerate(TEXTS * 8):
        spans, r = brute(text), found[i]
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest(), text
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert set(listed) <= set(r["spans"].split(",")) | {""}


def test_the_method_adds_secrets_and_leaves_clean_texts(found):
    def values(i):
        return {TEXTS[i][int(s):int(e)] for _, s, e in (x.split(":") for x in found[i]["spans"].split(",") if x)}

    assert {TOKEN, KEY, "hunter2abc99XY88"} <= values(8)
    assert {"123-45-6789", "DE89 3704 0044 0532 0130 00"} <= values(9)
    assert found[0]["spans"] == found[1]["spans"] == found[2]["spans"] == ""


def test_candidates_do_not_depend_on_a_digit_elsewhere():
    for text in ("password=CorrectHorseBattery", "api_key: abcdefghijk", "x ABCDQRSTUVWXABCDEFGHIJ y"):
        found = pii.candidates(text + " end")
        assert found and found == pii.candidates(text + " end 7"), text
    assert pii.candidates("no cue - here") == []


def test_expectation_maximisation_finds_reliable_labelers():
    # Votes of all labelers but the last agree; the last votes the other way round.
    yes = sum(2 * 3**i for i in range(4))
    no = 2 * 3**4
    p = pii.estimate([(4, yes, 80), (4, no, 20)])
    assert p[4, yes] > 0.95 and p[4, no] < 0.05
    assert pii.estimate([]) == {}


def test_redacted_documents_keep_their_columns(spark):
    docs = frame(spark, TEXTS * 8)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    rows = {r["doc_id"]: r for r in clean.collect()}
    assert rows[3]["text"] == "mail <email>, and é漢 <email>."
    assert KEY not in rows[8]["text"] and TOKEN not in rows[8]["text"]
    assert rows[0]["text"] is None and rows[2]["text"] == TEXTS[2]
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"] is not None)
    for i, text in enumerate(TEXTS):
        assert not brute(rows[i]["text"]), text


def test_no_rows_null_ids_and_repeated_rows(spark):
    assert pii.digest(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a@b.c"), (None, "a@b.c"), (1, "x")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in pii.digest(df).collect()) == [(0, "email:0:5"), (0, "email:0:5"), (1, "")]


def test_base_spans_equal_the_plain_patterns_on_random_texts():
    rng = random.Random(5)
    for alphabet in ("a@.-", "a@.1_ é", "0123.", "19 -.+()", "255.1 x@"):
        for _ in range(400):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
            assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    n = 2_000_000
    started = time.monotonic()
    assert pii.base_spans("1" * n) == []
    assert pii.base_spans("a" * n + "@" + "b" * n) == []
    assert pii.base_spans("1." * (n // 2) + "x")[0] == (0, 1, 7)
    assert pii.base_spans("a" * n + "@b.c") == [(0, 0, n + 4)]
    assert pii.base_spans("0" * 5000 + ".1.2.3") == [(0, 1, 5006)]
    assert time.monotonic() - started < 30


def test_decided_spans_do_not_overlap():
    rng = random.Random(6)
    weights = pii.np.full(len(pii.ADDED_KINDS) + len(pii.FEATURES), 5.0)
    for _ in range(100):
        base = sorted((s, rng.randrange(4), s + rng.randint(1, 9)) for s in rng.sample(range(100), 5))
        extra = [(s, rng.randrange(4, 9), s + rng.randint(1, 9), 0, rng.randrange(128)) for s in rng.sample(range(100), 30)]
        got = pii.decide(base, extra, weights)
        added = [x for x in got if x[1] >= 4]
        assert sorted(base + added) == got
        assert all(a is b or a[2] <= b[0] or a[0] >= b[2] for a in added for b in got)
        # Every candidate left out overlaps a span that stayed.
        for s, k, e, *_ in extra:
            assert (s, k, e) in got or any(e > x[0] and s < x[2] for x in got)
