"""Exact top-k search by inner product over norm-sorted blocks.

1. Components become integers, floor(1024 * x). The Gram matrix (d x d sums, combined in
   Spark) gives the rotation whose leading coordinates hold most of the vectors' length.
2. Vectors are range-partitioned and sorted by descending norm and packed into blocks, one
   row each; queries likewise. A block of the longest vectors gives every query a first
   threshold: its k-th score so far.
3. Query blocks are dealt to tiles, vector blocks to shards, both of bounded size; a task has one
   tile and one shard. A tile meets the shard's blocks one after the other, by descending norm. A
   query stops when |q| |v| falls below its threshold; what is left is pruned by the partial
   sum over leading coordinates plus the Cauchy-Schwarz bound of the residual, as a product of
   matrices. Survivors get their exact integer score, and raise the threshold. Where a trial
   shows that the bound leaves too much, all get their exact score, as one product.
4. A ranked window keeps the k best of each query, ties to the smaller id.

Every step is exact: pruning keeps equal scores and allows for rounding, and products are in
single precision only where all their sums are integers below 2^24. The driver gets d x d sums
and a block of the longest vectors; blocks go from task to task, none are broadcast. Defined
cases: null ids, null vectors and vectors with a null or non-finite component take no part;
shorter vectors are filled up with zeros; a candidate is never a row with the query's own id;
repeated query rows count once, repeated candidates each; an empty table gives no rows. Scores
must fit 53 bits, as inner products of integers held in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillet.llm.staging import staged

SCALE = 1024
VECTOR_BLOCK = 1024
QUERY_BLOCK = 256
#: Vectors of a block that are scored before thresholds are raised, with so many queries at once.
STEP = 256
QUERY_STEP = 2048
#: A block's vectors as doubles have at most so many bytes, whatever their length.
BLOCK_BYTES = 4 << 20
#: Queries of a tile and vectors of a shard, in bytes of single precision.
TILE_BYTES, SHARD_BYTES = 32 << 20, 128 << 20
#: An exact score of a single pair costs as much as this many in a product of matrices.
SINGLE = 80
#: Pairs of which a trial finds out what the bounds leave, and steps until the next trial.
TRIAL, TRIAL_STEPS = 64, 16

BLOCK_SCHEMA = pa.schema([("ids", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary()), ("max_norm", pa.float64()), ("tau", pa.binary())])
BLOCK_DDL = "ids binary, kind string, vectors binary, max_norm double, tau binary"


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, norm) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col)
    usable = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, finite))
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    whole = usable.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    return whole.withColumn("norm", F.sqrt(square))


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    """The vectors as rows of d doubles (shorter ones filled up with zeros)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), d))
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lists)), lengths), at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of the whole table, by descending singular value: (d, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column("v"), d)
            total += x.T @ x
        i, j = np.indices((d, d)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = vectors.select("v").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    gram = np.zeros((d, d))
    for r in sums.collect():  # d * d rows
        gram[r["i"], r["j"]] = r["s"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


def _narrow(x: np.ndarray) -> np.ndarray:
    """The integers in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def _blocks(rows: DataFrame, size: int, d: int, longest: tuple[np.ndarray, np.ndarray] | None, k: int) -> DataFrame:
    """Blocks of ``size`` rows by descending norm within each partition; with thresholds for queries."""

    def pack(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        norms = np.sqrt((x * x).sum(axis=1))
        tau = np.full(len(ids), -np.inf)
        if longest is not None and len(longest[0]):
            scores = x @ longest[1].T
            scores[ids[:, None] == longest[0][None, :]] = -np.inf
            if scores.shape[1] >= k:
                tau = np.partition(scores, -k, axis=1)[:, -k]
        narrow = _narrow(x)
        row = [[ids.tobytes()], [narrow.dtype.str], [narrow.tobytes()], [float(norms.max())], [tau.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.empty(0, np.int64), np.empty((0, d))
        for batch in batches:
            ids = np.concatenate([ids, batch.column("vec_id").to_numpy(zero_copy_only=False)])
            x = np.concatenate([x, _matrix(batch.column("v"), d)])
            while len(ids) >= size:
                yield pack(ids[:size], x[:size])
                ids, x = ids[size:], x[size:]
        if len(ids):
            yield pack(ids, x)

    return rows.select("vec_id", "v").mapInArrow(run, BLOCK_DDL)


class Tile:
    """Queries, their thresholds and the k best candidates so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, tau: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.tau, self.turn, self.k = ids, tau, turn, k
        self.d = q.shape[1]
        self.norm = np.sqrt((q * q).sum(axis=1))
        self.q = q.astype(np.float32) if np.abs(q).max(initial=0) < 1 << 24 else q  # both exact
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.heads = sorted({h for h in (self.d // 8, self.d // 4, self.d // 2) if h})
        self.turned: dict[int, np.ndarray] = {}
        self.steps, self.head = 0, 0
        self.room = {kind: np.empty(QUERY_STEP * STEP, kind) for kind in (np.float32, np.float64)}

    def _head(self, h: int) -> np.ndarray:
        """The h leading coordinates of the rotated queries and the length of the others, in single precision."""
        if h not in self.turned:
            out = np.empty((len(self.ids), h + 1), np.float32)
            for at in range(0, len(out), QUERY_STEP):
                out[at : at + QUERY_STEP] = _bounding(self.q[at : at + QUERY_STEP] @ self.turn, h)
            self.turned[h] = out
        return self.turned[h]

    def scan(self, v_ids: np.ndarray, v: np.ndarray) -> bool:
        """Meets vectors by descending norm; False if no query can take later ones, which are shorter."""
        v_norm = np.sqrt((v * v).sum(axis=1))
        alive = False
        for at in range(0, len(v), STEP):
            block = slice(at, at + STEP)
            longest = v_norm[block].max()
            live = np.flatnonzero(self.norm * (longest * (1 + 1e-9)) + 1e-6 >= self.tau)
            alive = len(live) > 0
            if not alive:
                break
            turned = v[block] @ self.turn
            if self.steps % TRIAL_STEPS == 0:
                self.head = self._trial(live[:TRIAL], turned, v_norm[block])
            self.steps += 1
            for i in range(0, len(live), QUERY_STEP):
                self._meet(live[i : i + QUERY_STEP], v_ids[block], v[block], turned, v_norm[block])
        return alive

    def _rounding(self, rows: np.ndarray, longest: float) -> np.ndarray:
        """What bounds in single precision can be too small by."""
        return 1e-6 + 4 * (self.d + 8) * 2.0**-24 * self.norm[rows] * longest

    def _bound(self, rows: np.ndarray, turned: np.ndarray, longest: float, h: int) -> np.ndarray:
        """Which pairs can reach their thresholds by the partial sum over h coordinates and the residual's bound."""
        least = (self.tau[rows] - self._rounding(rows, longest)).astype(np.float32)
        least = np.nextafter(least, np.float32(-np.inf))
        return self._head(h)[rows] @ _bounding(turned, h).T >= least[:, None]

    def _trial(self, rows: np.ndarray, turned: np.ndarray, v_norm: np.ndarray) -> int:
        """The number of leading coordinates by which to prune at the least cost; 0: none pays."""
        cost = {0: 1.0}
        for h in self.heads:
            cost[h] = (h + 1) / self.d + SINGLE * self._bound(rows, turned, v_norm.max(), h).mean()
        return min(cost, key=cost.get)

    def _meet(self, rows: np.ndarray, v_ids: np.ndarray, v: np.ndarray, turned: np.ndarray, v_norm: np.ndarray) -> None:
        longest = v_norm.max()
        tau = self.tau[rows]
        if self.head:
            a, b = np.nonzero(self._bound(rows, turned, longest, self.head))
            for h in [h for h in self.heads if h > self.head]:
                if not len(a):
                    return
                part = np.einsum("ij,ij->i", self._head(h)[rows[a]], _bounding(turned, h)[b])
                left = part + self._rounding(rows[a], longest) >= tau[a]
                a, b = a[left], b[left]
            score = np.empty(len(a))
            for i in range(0, len(a), 1 << 16):
                at = slice(i, i + (1 << 16))
                score[at] = np.einsum("ij,ij->i", self.q[rows[a[at]]].astype(np.float64), v[b[at]])
            left = score >= tau[a]
        else:
            # Every partial sum is an integer of at most |q| |v|.
            kind = np.float32 if self.norm[rows].max() * longest < (1 << 24) * 0.99 else np.float64
            all_ = self.room[kind][: len(rows) * len(v)].reshape(len(rows), len(v))
            own = self.q[rows[0] : rows[-1] + 1] if rows[-1] - rows[0] == len(rows) - 1 else self.q[rows]
            np.matmul(own.astype(kind, copy=False), v.astype(kind).T, out=all_)
            some = np.flatnonzero(all_.max(axis=1) >= tau)
            a, b = np.nonzero(all_[some] >= tau[some, None])
            score = all_[some[a], b].astype(np.float64)
            a, left = some[a], slice(None)
        self._keep(rows[a[left]], v_ids[b[left]], score[left])

    def _keep(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """The k best of the candidates so far and these."""
        last_score, last = self.score[rows, -1], self.found[rows, -1]
        better = ((score > last_score) | (score == last_score) & (ids < last)) & (ids != self.ids[rows])
        rows, ids, score = rows[better], ids[better], score[better]
        if not len(rows):
            return
        own = np.unique(rows)
        all_rows = np.concatenate([np.repeat(own, self.k), rows])
        all_ids = np.concatenate([self.found[own].ravel(), ids])
        all_score = np.concatenate([self.score[own].ravel(), score])
        order = np.lexsort((all_ids, -all_score, all_rows))
        first = np.searchsorted(all_rows[order], own)
        best = order[first[:, None] + np.arange(self.k)]
        self.score[own], self.found[own] = all_score[best], all_ids[best]
        self.tau[own] = np.maximum(self.tau[own], self.score[own, -1])

    def best(self) -> pa.RecordBatch:
        some = np.isfinite(self.score)
        query = np.repeat(self.ids, some.sum(axis=1))
        columns = [pa.array(x) for x in (query, self.found[some], self.score[some].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])


def _bounding(turned: np.ndarray, h: int) -> np.ndarray:
    """Rotated vectors' h leading coordinates and the length of the others: their products bound the whole ones."""
    out = np.empty((len(turned), h + 1), np.float32)
    out[:, :h] = turned[:, :h]
    out[:, h] = np.sqrt((turned[:, h:] ** 2).sum(axis=1))
    return out


def _matches(batches: Iterator[pa.RecordBatch], d: int, turn: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of blocks by cell; in each the queries' first, then the vectors' by descending norm."""
    cell, tile, queries, over = None, None, [], False
    for batch in batches:
        for i in range(batch.num_rows):
            got = {c: batch.column(c)[i] for c in batch.schema.names}
            if got["cell"].as_py() != cell:
                if tile:
                    yield tile.best()
                cell, tile, queries, over = got["cell"].as_py(), None, [], False
            ids = np.frombuffer(got["ids"].as_buffer(), np.int64)
            x = np.frombuffer(got["vectors"].as_buffer(), got["kind"].as_py()).reshape(-1, d)
            if not got["is_vector"].as_py():
                queries.append((ids.copy(), x.copy(), np.frombuffer(got["tau"].as_buffer())))
            elif queries and not over:
                if not tile:
                    q_ids, q, tau = (np.concatenate(c) for c in zip(*queries, strict=True))
                    tile = Tile(q_ids, q.astype(np.float64), tau.copy(), turn, k)
                    queries = [()]
                over = not tile.scan(ids, x.astype(np.float64))
    if tile:
        yield tile.best()


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of every query row's k best other rows."""
    spark = vectors.sparkSession
    # Blocks go to Python workers a few at a time, whatever their number of rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    rows = staged(integers(vectors, id_col, vector_col), "vectors")
    d, n_vectors, n_queries = rows.agg(F.max(F.size("v")), F.count(F.lit(1)), F.count_if(is_query)).first()
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(rows, d)
    # A bounded sample: first thresholds. Sorted and cut by tasks; the driver gets what is left.
    top = staged(rows.orderBy(F.desc("norm"), "vec_id").limit(VECTOR_BLOCK), "longest").collect()
    longest = (np.array([r["vec_id"] for r in top]), np.array([list(r["v"]) + [0.0] * (d - len(r["v"])) for r in top]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("norm"), "vec_id")
    sort = lambda df: df.repartitionByRange(n, *order).sortWithinPartitions(*order, "v")
    size = lambda most: max(1, min(most, BLOCK_BYTES // (8 * d)))
    queries = rows.where(is_query).dropDuplicates(["vec_id"])
    v = _blocks(sort(rows), size(VECTOR_BLOCK), d, None, k)
    q = _blocks(sort(queries), size(QUERY_BLOCK), d, longest, k)

    tiles = max(1, -(-n_queries * 4 * d // TILE_BYTES))
    shards = max(-(-n_vectors * 4 * d // SHARD_BYTES), -(-2 * spark.sparkContext.defaultParallelism // tiles))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("ids"), F.lit(count)).cast("int")
    q = q.select("*", dealt(tiles).alias("tile"), each(shards).alias("shard"), F.lit(False).alias("is_vector"))
    v = v.select("*", each(tiles).alias("tile"), dealt(shards).alias("shard"), F.lit(True).alias("is_vector"))
    cells = q.union(v).withColumn("cell", F.col("tile") * shards + F.col("shard")).drop("tile", "shard")
    sorted_ = cells.repartitionById(tiles * shards, "cell").sortWithinPartitions("cell", "is_vector", F.desc("max_norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _matches(batches, d, turn, k)

    found = sorted_.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 100 == 0)
