"""Near-duplicate groups: a multi-index Hamming join over b-bit MinHash signatures.

1. A document's set of word shingles gives its size, a 128-bit fingerprint and a signature
   of ``CHUNKS * WIDTH`` b-bit minhash symbols. Equal sets are one class from here on, with a
   number of its own, so that rows without an id or with the same one are not mixed up.
2. The signature is split into ``CHUNKS`` chunks. By the pigeonhole principle, signatures that
   differ in at most ``CHUNKS * (ERRORS + 1) - 1`` symbols have a chunk with at most ``ERRORS``
   differing symbols; each chunk is indexed once per choice of ``ERRORS`` positions left out, so
   such a pair always meets in a bucket. Pairs further apart mostly meet too: a pair at
   similarity s is missed with (1 - P(a chunk matches))^CHUNKS, 5e-7 at 0.85.
3. A bucket is not expanded into pairs. Its members are linked to its smallest member; the
   ones too far from that one are taken up again, and in the end only members of different
   components meet, where the largest component of a bucket never meets itself. The members of
   crowded buckets (copies that are similar, but not enough) are not paired at all: a family of
   them is dealt to blocks by size, two blocks are compared on full sets inside one task as
   products of matrices, and only links that join two components come out of it.
4. Every link counts only after the full sets confirm it. Components follow from the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.llm.components import components
from rillet.llm.staging import staged
from rillet.llm.words import mix, pieces, windows, words_of

CHUNKS, WIDTH, ERRORS = 8, 5, 1
SYMBOLS = CHUNKS * WIDTH
#: A pair whose signatures differ in more symbols is not compared: P(more | 0.85) < 1e-8.
MAX_DISTANCE = 21
#: Keys of rows to be fetched are broadcast up to this many rows (24 bytes each), else shuffled.
BROADCAST_IDS = 1_000_000
STAR_ROUNDS = 2
#: Members of different components in buckets beyond this size are compared in blocks.
CROWD = 16
#: Sets and shingles of a block, columns of a product.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 512, 400_000, 2048

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(5))
_MULTIPLY = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.int64).astype(_U) | _U(1)
_ADD = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.int64).astype(_U)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text: (hash, number of them in each text).

    A text with fewer than k words has its whole sequence as one shingle, one without words none.
    """
    words = words_of(texts)
    hashes = words.hashes()
    whole, row, _ = windows(hashes, words.counts, k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    for n in range(1, k):
        some = short[words.counts[short] == n]
        one = np.full(len(some), n, _U)
        for j in range(n):
            one = mix(one * _U(0x9E3779B97F4A7C15) + hashes[words.first[some] + j] + _U(j + 1))
        whole, row = np.concatenate([whole, one]), np.concatenate([row, some])
    order = np.lexsort((whole, row))
    whole, row = whole[order], row[order]
    fresh = np.ones(len(whole), bool)
    fresh[1:] = (whole[1:] != whole[:-1]) | (row[1:] != row[:-1])
    return whole[fresh], np.bincount(row[fresh], minlength=words.n)


#: What tells rows apart: 128 bits of the id and the text.
ROW = ["row_a", "row_b"]


def with_row(docs: DataFrame) -> DataFrame:
    """The rows with ``ROW``, which are equal where id and text are; null is a value of its own."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), F.col("text")]
    return docs.withColumns({"row_a": F.xxhash64(*parts), "row_b": F.xxhash64(F.lit("row"), *parts[::-1])})


def _signatures(k: int):
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", *ROW, "n_shingles", "set_a", "set_b")] + [("signature", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, counts = shingles(batch.column("text"), k)
            full = np.flatnonzero(counts)
            start = (np.cumsum(counts) - counts)[full]
            sums = np.zeros((2, len(counts)), _U)
            signature = np.zeros((len(counts), SYMBOLS), "<u2")
            if len(full):
                sums[0, full] = np.add.reduceat(mix(hashes), start)
                sums[1, full] = np.add.reduceat(mix(hashes ^ _ADD[0]), start)
                for j in range(SYMBOLS):
                    values = (hashes * _MULTIPLY[j] + _ADD[j]) >> _U(32)
                    signature[full, j] = np.minimum.reduceat(values, start) & _U(0xFFFF)
            signed = [pa.array(x.view(np.int64)) for x in sums]
            raw = signature.tobytes()
            width = SYMBOLS * 2
            binary = pa.array([raw[i * width : (i + 1) * width] for i in range(len(counts))], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).cast(pa.int64()) for c in ("doc_id", *ROW)], pa.array(counts.astype(np.int64)), *signed, binary], schema=schema
            )

    return run, "doc_id long, row_a long, row_b long, n_shingles long, set_a long, set_b long, signature binary"


def _chunk_keys():
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            symbols = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(n, SYMBOLS).astype(_U)
            ids = batch.column("class")
            for chunk in range(CHUNKS):
                for left_out in range(WIDTH):
                    key = np.full(n, chunk * WIDTH + left_out + 1, _U)
                    for j in range(WIDTH):
                        if j != left_out:
                            key = mix(key * _U(0x9E3779B97F4A7C15) + symbols[:, chunk * WIDTH + j])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids], schema=schema)

    return run, "key long, id long"


def _distance():
    @F.pandas_udf("int")
    def distance(x, y):
        import pandas as pd

        one = np.frombuffer(b"".join(x), "<u2").reshape(len(x), SYMBOLS)
        two = np.frombuffer(b"".join(y), "<u2").reshape(len(y), SYMBOLS)
        return pd.Series((one != two).sum(axis=1).astype(np.int32))

    return distance


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the wanted similarity."""
    side = lambda s: classes.select(
        F.col("class").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = both.where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
    return sized.where(_distance()("s_a", "s_b") <= MAX_DISTANCE).select("a", "b")


def _sets(docs: DataFrame, ids: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(class, shingles): the full shingle sets of the wanted classes, from the row that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, counts = shingles(batch.column("text"), k)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("class"), lists], names=["class", "shingles"])

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = classes.join(ids, classes["class"] == ids["id"], "left_semi").select("class", *[F.col(f"best.{c}").alias(c) for c in ROW])
    wanted = F.broadcast(wanted) if few else wanted.hint("shuffle_hash")
    chosen = docs.join(wanted, ROW).select("class", "text")
    # Rows repeated with id and text are read more than once.
    return staged(chosen.mapInArrow(run, "class long, shingles array<long>").dropDuplicates(["class"]), "shingle-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * |intersection| >= percent * |union| on full sets."""
    side = lambda s: sets.select(F.col("class").alias(s), F.col("shingles").alias(f"x_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("x_a", "x_b"))
    sizes = F.size("x_a") + F.size("x_b")
    return both.where(F.lit(100) * common >= F.lit(percent) * (sizes - common)).select("a", "b")


def _largest(members: DataFrame) -> DataFrame:
    """(key, n, largest) of the keys with members (key, id, component) of several components."""
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    keys = parts.groupBy("key").agg(
        F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")
    )
    return keys.where("parts > 1").select("key", "n", "largest")


def _across(members: DataFrame) -> DataFrame:
    """Pairs of members of one key from different components; the largest component never meets itself."""
    one = members.where("component <> largest").select("key", *[F.col(c).alias(f"_{c}") for c in members.columns if c != "key"])
    # Both ends outside the largest component: each pair once.
    meet = F.expr("component <> _component AND (component = largest OR _id < id)")
    met = one.join(members, (one["key"] == members["key"]) & meet)
    return met.select(F.least("_id", "id").alias("a"), F.greatest("_id", "id").alias("b")).distinct()


def _families(crowd: DataFrame) -> DataFrame:
    """(id, component, family): members (key, id, component) that share crowded buckets, directly or over others."""
    heads = crowd.groupBy("key").agg(F.min("id").alias("b"))
    edges = crowd.join(heads, "key").select(F.col("id").alias("a"), "b").distinct()
    family = components(edges).withColumnRenamed("component", "family")
    return crowd.select("id", "component").distinct().join(family, "id")


def _cells(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(cell columns, side, id, component): which blocks of a family meet in one task.

    A member's size gives its level, such that only sets of one level or of neighbouring ones
    can be similar enough; a family's level is dealt to blocks of at most about ``BLOCK_SETS``
    sets and ``BLOCK_SHINGLES`` shingles, and every two blocks of the same or neighbouring levels
    are a cell.
    """
    size = classes.select(F.col("class").alias("id"), "n_shingles")
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0) / percent)).cast("long")
    sized = members.join(size, "id").withColumn("level", level)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long")
    levels = staged(sized.groupBy("family", "level").agg(blocks.alias("blocks")), "levels")
    own = sized.join(levels, ["family", "level"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # floats may put a size on the wrong side of a level's border: two levels apart meet as well
    step = F.explode(F.array(*[F.lit(d).cast("long") for d in range(-2, 3)]))
    other = own.select("*", step.alias("step")).withColumn("to", F.col("level") + F.col("step"))
    reach = levels.select(F.col("family"), F.col("level").alias("to"), F.col("blocks").alias("others"))
    met = other.join(reach, ["family", "to"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("with"))
    one, two = F.struct(F.col("level").alias("l"), F.col("block").alias("b")), F.struct(F.col("to").alias("l"), F.col("with").alias("b"))
    return met.select(
        "family", F.least(one, two).alias("low"), F.greatest(one, two).alias("high"),
        F.when(one > two, 1).otherwise(0).cast("long").alias("side"), "id", "component",
    )


def _common(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each two of ``n`` sets share; (row, column) are their entries."""
    out = np.zeros((n, n), np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
        lo, hi = np.searchsorted(columns, [start, start + COLUMNS])
        dense = np.zeros((n, COLUMNS), np.float32)
        dense[rows[lo:hi], columns[lo:hi] - start] = 1
        out += dense @ dense.T
    return out


def _joining(percent: int):
    """Links of a cell that join two components, one less than there are components at most."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, ids, component = table.num_rows, table.column("id").to_numpy(), table.column("component").to_numpy()
        a: list[int] = []
        b: list[int] = []
        if len(np.unique(component)) > 1:
            lists = table.column("shingles").combine_chunks()
            counts = np.diff(lists.offsets.to_numpy())
            _, columns, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
            shared = times > 1  # a shingle of one set is shared with none
            number = np.cumsum(shared) - 1
            held = shared[columns]
            common = _common(np.repeat(np.arange(n), counts)[held], number[columns[held]], n).astype(np.int64)
            union = counts[:, None] + counts[None, :] - common
            linked = (100 * common >= percent * union) & (component[:, None] != component[None, :])
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
                x, y = find(int(component[i])), find(int(component[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def grouped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, row_a, row_b, n_shingles, component_id, first) of every row.

    ``docs`` has doc_id (integer) and text; other columns are not read. ``component_id`` is the
    smallest id of the component, null if it has none. ``first`` marks one text of each
    component, that of the smallest id (all rows with that id and text). Null or empty texts and
    texts without words have an empty set and stay alone. Works for thresholds of about 0.8 and
    more, for which the index is laid out.
    """
    docs = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    signed = staged(docs.mapInArrow(*_signatures(k)), "signatures")
    same = ["set_a", "set_b", "n_shingles"]
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW)
    classes = signed.where("n_shingles > 0").groupBy(*same).agg(F.first("signature").alias("signature"), F.min(best).alias("best"))
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    keys = classes.select("class", "signature").mapInArrow(*_chunk_keys())
    heads = keys.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = staged(keys.join(heads.select("key", "head"), "key"), "buckets")

    # Stars: each member with its bucket's head; who is far from it gets the head of the rest.
    members, stars = buckets, []
    for step in range(STAR_ROUNDS):
        pairs = members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
        close = staged(_close(pairs, classes, percent), "star")
        stars.append(close)
        if step + 1 < STAR_ROUNDS:
            far = members.where("id <> head").join(
                close, (F.col("head") == F.col("a")) & (F.col("id") == F.col("b")), "left_anti"
            ).select("key", "id")
            heads = far.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
            members = staged(far.join(heads.select("key", "head"), "key"), "buckets")
    star = stars[0]
    for more in stars[1:]:
        star = star.union(more)
    star = staged(star.distinct(), "star")
    ids = lambda p: p.select(F.col("a").alias("id")).union(p.select(F.col("b").alias("id"))).distinct()
    links = staged(_confirmed(star, _sets(docs, staged(ids(star), "ids"), classes, k), percent), "links")
    found = staged(components(links), "found")

    # What is left: members of one bucket in different components, but for its largest one.
    placed = buckets.select("key", "id").join(found, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")
    )
    largest = _largest(placed)
    open_ = staged(placed.join(largest, "key"), "open")
    few = _across(open_.where(F.col("n") <= CROWD))
    crowd = staged(open_.where(F.col("n") > CROWD).select("key", "id", "component"), "crowd")
    members = staged(_families(crowd), "families")
    sets = _sets(docs, members.select("id").distinct(), classes, k)
    cells = _cells(members, classes, percent).join(sets.withColumnRenamed("class", "id"), "id")
    joining = staged(cells.groupBy("family", "low", "high").applyInArrow(_joining(percent), "a long, b long"), "joining")
    known = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = staged(_close(few.join(known, ["a", "b"], "left_anti"), classes, percent), "across")
    more = _confirmed(rest, _sets(docs, staged(ids(rest), "ids"), classes, k), percent)
    linked = components(links.union(more).union(joining)).withColumnRenamed("id", "class")

    placed = classes.join(linked, "class", "left").select(*same, "best", F.coalesce("component", "class").alias("component"))
    firsts = placed.groupBy("component").agg(F.min("best").alias("first"))
    placed = placed.join(firsts, "component").select(*same, "first")
    is_first = F.coalesce((F.col("row_a") == F.col("first.row_a")) & (F.col("row_b") == F.col("first.row_b")), F.lit(True))
    id_ = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return signed.select("doc_id", *ROW, *same).join(placed, same, "left").select(
        "doc_id", *ROW, "n_shingles", id_.alias("component_id"), is_first.alias("first")
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document with an id; repeated rows stay repeated."""
    return grouped(docs.where("doc_id IS NOT NULL"), k, percent).select("doc_id", "n_shingles", "component_id")


def digest(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """Rows without an id have the size of their set, and neither link nor component: an id names both."""
    lone = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = with_row(lone).mapInArrow(*_signatures(k)).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    groups = near_duplicates(docs, k, percent).union(sizes)
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))
