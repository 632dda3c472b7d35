import re
from collections import Counter

import pytest

from rillet.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


TEXTS = [
    None,
    "",
    " \t\n",
    "one two three",
    "a b c d e a b c d e",
    "a b c d e f a b c d e g a b c d e",
    "x " * 5000,
    "line one is here\nline one is here\n \nother é漢 line\n other é漢 line",
    "w$$$ x### y&&& z*** " * 10,
    "the quick brown fox jumps over the lazy dog and then it sleeps for a long while",
    "\x0bа б\x0cв г д е ж з и к",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, failed_bits string")


def test_measurements_are_those_of_brute_force(spark):
    got = {r["doc_id"]: r for r in q.ledger(rows(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, text


def test_policies_read_the_ledger_bits(spark):
    got = {r["doc_id"]: r for r in q.digest(rows(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        m = brute(text)
        failed = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        assert got[i]["base_failed"] == failed
        assert not (failed and got[i]["kept"])
    assert got[9]["kept"] and not got[8]["kept"]


@pytest.mark.parametrize("policy", list(q.POLICIES))
def test_ablations_are_those_of_judging_anew(spark, policy):
    entries = q.ledger(rows(spark, TEXTS)).cache()
    bits = [r["failed_bits"] for r in entries.select("failed_bits").collect()]
    mask = q.mask_of(policy)
    got = {r["rule"]: r for r in q.ablations(entries, policy).collect()}
    assert set(got) == set(q.POLICIES[policy])
    for rule in q.RULES:
        if rule.name in got:
            one = 1 << rule.bit
            assert got[rule.name]["n_failed"] == sum(b & one > 0 for b in bits)
            assert got[rule.name]["n_failed_alone"] == sum(b & mask == one for b in bits)
            assert got[rule.name]["n_kept_without"] == sum(b & mask & ~one == 0 for b in bits)
    entries.unpersist()


def test_keep_is_the_policy_and_keeps_all_columns(spark):
    docs = rows(spark, TEXTS)
    kept = q.keep(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in q.digest(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_no_rows_repeated_rows_and_null_ids(spark):
    assert q.digest(rows(spark, [])).count() == 0
    twice = rows(spark, TEXTS).union(rows(spark, TEXTS)).selectExpr("nullif(doc_id, 3) AS doc_id", "text")
    assert q.digest(twice).count() == 2 * len(TEXTS)


def test_plan_is_native(spark):
    plan = q.digest(rows(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
