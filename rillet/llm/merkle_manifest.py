"""Merkle manifest of a dataset by a nested-struct rollup, with an inclusion proof for each row.

1. A row becomes a leaf: the SHA-256 of its columns, length-prefixed, so that null, empty and
   shifted values differ. Leaves are ranked by id within their source, across tasks, so that
   a source with most of the rows is cut like any other.
2. A rank is a number in base ``FAN``; its last ``DIGITS`` digits place a leaf in a block of
   ``FAN ** DIGITS``, the rest names the block. Within a block the digits are grouped away one
   after the other, lowest first: the children's structs (digit, hash, children) become an array
   of at most ``FAN`` inside their parent. All groupings of a block follow one exchange.
3. A block's hash is a leaf of the next rollup, ranked by its block number, until each source
   is one node. The sources' hashes, in their order, are rolled up the same way to the root.
4. On the way down, a block and the path of its own hash meet in one group (a block is one row
   on either side), and its nested struct is exploded digit by digit; each step adds the
   hashes to the left and right of the child. No rows are joined, and no task holds more than
   blocks of ``FAN ** DIGITS`` leaves.

The first node of a level with a single child has no neighbours: it is the last of its tree and
keeps its hash. Every other run is hashed, also one of a single node.

Defined cases: null columns are ``-`` in a leaf; null ids come first in a source, a null source
first of all; rows with the same id are ordered by leaf; repeated rows are leaves each. A null
id is not tampered with. Empty tables have no rows and no root. Texts are hashed whole. Other
columns of the input, whatever their names, take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.llm.staging import staged
from rillet.operators.offsets import assign_offsets, staging_area

FAN = 3
DIGITS = 6
#: Columns of a leaf, in their order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")

STEPS = "array<struct<left:string,right:string>>"


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(**changed: Column) -> Column:
    """The leaf of a row, with some of its columns ``changed``."""
    values = [changed.get(c, F.col(c)).cast("string") for c in LEAF]
    return digest_of(
        *[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    )


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, start, lambda acc, s: digest_of(s["left"], acc, s["right"]))


def siblings(steps: Column) -> Column:
    """The proof's hashes, level by level upward, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


# --------------------------------------------------------------------- ranks
def ranked(rows: DataFrame, tree: Column, *order: str) -> DataFrame:
    """``rows`` with ``tree`` and their ``rank`` in it: dense, numbered across tasks."""
    rows = rows.select(tree.alias("topic"), F.lit(0).alias("partition"), *rows.columns)
    with staging_area(rows.sparkSession) as area:
        numbered = assign_offsets(rows, [*order], staging=area)
        return staged(numbered.withColumnsRenamed({"topic": "tree", "offset": "rank"}).drop("partition"), "manifest-ranks")


# -------------------------------------------------------------------- rollup
def nest(nodes: DataFrame) -> DataFrame:
    """(tree, block, node) of (tree, rank, hash, ...): each block of nodes as one nested struct.

    ``node`` is (digit, hash, kids), its kids the same, down to (digit, hash, row): all other
    columns of ``nodes`` are the ``row`` of a leaf.
    """
    row = F.struct(*[c for c in nodes.columns if c not in ("tree", "rank", "hash")] or [F.lit(True).alias("leaf")])
    size = FAN**DIGITS
    digits = [f"_d{i}" for i in range(DIGITS)]
    rank = F.col("rank")
    level = nodes.select(
        "tree",
        F.floor(rank / size).alias("block"),
        *[F.pmod(F.floor(rank / FAN**i), F.lit(FAN)).cast("int").alias(d) for i, d in enumerate(digits)],
        F.struct("hash", row.alias("row")).alias("node"),
    ).repartition("tree", "block")
    for i, digit in enumerate(digits):
        above = digits[i + 1 :]
        kid = F.struct(F.col(digit).alias("digit"), "node.*")
        level = level.groupBy("tree", "block", *above).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        first = reduce(Column.__and__, [F.col(c) == 0 for c in ("block", *above)])
        hashed = digest_of(F.array_join(F.transform("kids", lambda k: k["hash"]), ""))
        alone = first & (F.size("kids") == 1)
        level = level.select(
            "tree", "block", *above,
            F.struct(F.when(alone, F.col("kids")[0]["hash"]).otherwise(hashed).alias("hash"), F.col("kids")).alias("node"),
        )
    return level


def unnest(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, rank, hash, steps, top, row) of each node in ``blocks``, given ``above`` them.

    ``above``: (tree, rank, steps, top) of each block's own hash, its number as ``rank``.
    """
    spark = blocks.sparkSession
    paths = above.select("tree", F.col("rank").alias("block"), F.struct("steps", "top").alias("path"))
    met = blocks.unionByName(paths, allowMissingColumns=True).groupBy("tree", "block").agg(
        F.first("node", ignorenulls=True).alias("node"), F.first("path", ignorenulls=True).alias("path")
    )
    level = met.select("tree", F.col("block").alias("rank"), "node", "path.steps", "path.top")
    for _ in range(DIGITS):
        level = level.select("tree", "rank", "node", "steps", "top", F.posexplode("node.kids").alias("at", "kid"))

        def side(start: Column, length: Column) -> Column:
            return F.array_join(F.transform(F.slice("node.kids", start, length), lambda k: k["hash"]), "")

        at = F.col("at")
        step = F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.lit(FAN)).alias("right"))
        passed = (F.size("node.kids") == 1) & (F.col("kid.hash") == F.col("node.hash"))
        level = level.select(
            "tree",
            (F.col("rank") * FAN + F.col("kid.digit")).alias("rank"),
            F.col("kid").alias("node"),
            F.when(passed, F.col("steps")).otherwise(F.concat(F.array(step), "steps")).alias("steps"),
            "top",
        )
    return level.select("tree", "rank", "node.hash", "steps", "top", "node.row")


def rollup(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of every rollup of (tree, rank, hash, ...), lowest first; the last has one for each tree."""
    levels = []
    while True:
        blocks = staged(nest(nodes), "manifest-blocks")
        levels.append(blocks)
        if not (blocks.agg(F.max("block")).first()[0] or 0):
            return levels
        nodes = blocks.select("tree", F.col("block").alias("rank"), "node.hash")


def proofs(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, rank, hash, steps, top, row) of the lowest nodes; ``above``: (tree, steps, top) of each tree."""
    paths = above.withColumn("rank", F.lit(0).cast("long"))
    for blocks in reversed(levels):
        paths = unnest(blocks, paths)
    return paths


# ------------------------------------------------------------------ manifest
def manifest(docs: DataFrame, **carried: Column) -> DataFrame:
    """Each document's place in the dataset's tree, with the proof that leads to the root.

    (doc_id, source, rank, leaf, subroot, root, steps, and the ``carried`` columns, computed in
    the scan). ``fold(leaf, steps)`` gives the root again; ``rank`` counts from 0 in the source.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", leaf().alias("hash"),
        *[value.alias(name) for name, value in carried.items()],
    )
    # a tree's name tells a null source from any other, and sorts before them
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    of_source = rollup(ranked(rows, tree, "doc_id", "hash"))
    subroots = of_source[-1].select(F.col("tree").alias("name"), "node.hash")
    of_all = rollup(ranked(subroots, F.lit("all"), "name"))
    start = of_all[-1].select("tree", F.array().cast(STEPS).alias("steps"), F.struct(F.col("node.hash").alias("root")).alias("top"))
    up = proofs(of_all, start)
    above = up.select(
        F.col("row.name").alias("tree"), "steps", F.struct(F.col("hash").alias("subroot"), "top.root").alias("top")
    )
    down = proofs(of_source, above)
    return down.select(
        "row.doc_id", "row.source", "rank", F.col("hash").alias("leaf"), "top.subroot", "top.root", "steps",
        *[f"row.{name}" for name in carried],
    )


def digest(docs: DataFrame) -> DataFrame:
    """Proofs, and what a tampered row folds to: every second id loses its text's line ends."""
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    changed = leaf(text=F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))
    rows = manifest(docs, presented=F.when(tampered, changed).otherwise(leaf()))
    rows = rows.withColumn("folded_root", fold(F.col("presented"), F.col("steps")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
