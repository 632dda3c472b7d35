import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rillet.llm import merkle_manifest as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank int, hash string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    values = [doc_id, source, lang, n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """(root, the steps of each leaf), by the definition."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, node in enumerate(at):
            run = level[node // 3 * 3 : node // 3 * 3 + 3]
            steps[i].append((run[: node % 3], run[node % 3 + 1 :]))
        at = [node // 3 for node in at]
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], steps


def brute(rows):
    of = {}
    for r in rows:
        of.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(*r[:5]), r))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for own in of.values():
        own.sort(key=lambda x: x[:3])
    trees = {s: tree([x[2] for x in own]) for s, own in of.items()}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (_, _, leaf, r), own in zip(of[s], trees[s][1], strict=True):
            steps = own + up
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                at = leaf_of(r[0], r[1].replace("\n", ""), *r[2:5])
            for left, right in steps:
                at = h(*left, at, *right)
            proof = h(*[x for left, right in steps for x in left + right])
            out.append((r[0], leaf, trees[s][0], root, proof, at, at == root))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted(map(tuple, m.digest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def row(doc_id, text="a\nb", lang="en", source="s", n_chars=3):
    return (doc_id, text, lang, source, n_chars, "x", 5, "y")


@pytest.mark.parametrize("digits", [2, 6])
def test_equals_the_definition(spark, monkeypatch, digits):
    """One hot source over many blocks, small ones around the powers, nulls, repeated ids and rows."""
    monkeypatch.setattr(m, "DIGITS", digits)
    rows = [row(i * 7 % 100, f"line {i}\nnext", source="hot") for i in range(100)]
    rows += [row(1000 + 100 * n + i, source=f"of{n}") for n in (1, 2, 3, 4, 9, 10, 27, 28, 81, 82) for i in range(n)]
    rows += [row(None), row(None, None, None, None, None), row(3, "", "", "", 0), row(3, None, "é", "é"), row(3, "x\n" * 50_000)]
    rows += [row(5), row(5), row(-5, "-", "-", "-", -1), row(2, None, None, None, None)]
    assert got(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert got(spark, []) == []
    one = [row(4, "no line end")]
    assert got(spark, one) == brute(one)
    assert got(spark, one)[0][2] == got(spark, one)[0][3] == leaf_of(*one[0][:5])


def test_proof_shows_a_changed_row(spark):
    docs = spark.createDataFrame([row(i, f"t{i}") for i in range(40)], SCHEMA)
    out = m.manifest(docs, wrong=m.leaf(text=F.lit("other")))
    seen = out.select(m.fold(F.col("leaf"), F.col("steps")) == F.col("root"), m.fold(F.col("wrong"), F.col("steps")) == F.col("root"))
    assert {tuple(r) for r in seen.collect()} == {(True, False)}
