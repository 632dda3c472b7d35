import random

import pytest

from rillet.sources.csv_records import csv_records, read_csv

SCHEMA = "id long, text string, note string"


def written(folder, rows, ends="\n"):
    quote = lambda x: "" if x is None else '"' + x.replace('"', '""') + '"'
    body = ends.join(["id,text,note", *[f"{i},{quote(t)},{quote(n)}" for i, t, n in rows]]) + ends
    folder.write_bytes(body.encode())


def table(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b c", ",", "\n", '"', "\n\n", "é漢", "\r\n", '",\n1,"', "x" * 40, " "]
    text = lambda: "t" + "".join(rng.choices(parts, k=rng.randint(0, 12))) + "."
    rows = [(i, text() if rng.random() < 0.9 else None, text()) for i in range(n)]
    # One record longer than several splits.
    rows[n // 2] = (n // 2, "long\n" * 3000, "end")
    return rows


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_records_across_splits_equal_the_rows(spark, tmp_path, small_splits):
    folder = tmp_path / "csv"
    folder.mkdir()
    rows = []
    for k, ends in enumerate(["\n", "\r\n", "\n"]):
        own = [(1000 * k + i, t, n) for i, t, n in table(300, k)]
        written(folder / f"f{k}.csv", own, ends)
        rows += own
    (folder / "empty.csv").write_bytes(b"")
    (folder / "header.csv").write_bytes(b'id,"te\nxt",note\n')
    got = read_csv(spark, str(folder), SCHEMA)
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    reader = spark.read.schema(SCHEMA).options(header=True, multiLine=True, escape='"').csv(str(folder))
    # Spark's reader turns \r\n inside quotes into \n.
    plain = lambda rows: sorted((i, (t or "").replace("\r\n", "\n"), n.replace("\r\n", "\n")) for i, t, n in rows)
    assert plain(map(tuple, reader.collect())) == plain(rows)


def test_no_header_long_header_and_open_quote(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('1,"a\nb",c\n\n2,d,"left open\n\nto the end')
    assert sorted(r["text"] for r in csv_records(spark, str(tmp_path / "a.csv"), header=False).collect()) == [
        '1,"a\nb",c', '2,d,"left open\n\nto the end',
    ]
    (tmp_path / "b.csv").write_text('id,"' + "name\n" * 2000 + '",note\n7,x,"y\nz"\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "b.csv"), SCHEMA).collect()] == [(7, "x", "y\nz")]
