"""Line dedup through a sharded minimal perfect hash over the repeated lines.

1. A document's distinct line keys (white space stripped at both ends, A-Z lower-cased, at
   least ``min_chars`` code points) become 128-bit hashes. Spark counts the documents of each
   hash and takes its largest doc_id, combined map-side, so that one very common line is a
   few rows of a shuffle.
2. The hashes found in at least ``min_documents`` documents are dealt to shards of about
   ``SHARD_KEYS`` keys by their first half. A shard becomes a minimal perfect hash (levels of
   bit arrays in which a key without a rival keeps its place; its slot is the rank of its bit)
   and, by slot, arrays of fingerprints, document counts and largest ids: about 25 bytes a key.
3. Documents probe the arrays; there is no join of lines. A line that is not indexed falls on
   some slot and is told by the fingerprint: the second 64 bits of its hash, so that a wrong
   match has a chance of 2^-64 a probe. Shards of ``BROADCAST_BYTES`` in all go to every
   worker, and the texts stay in their scan. Beyond that, hashes are sent to the shards: each
   shard is copied to as many cells as its documents need (one very common line is spread
   over the cells of its shard), and what must go comes back by document.

Defined cases: null and empty texts are one empty line. A row is a document: repeated rows
count each. A null doc_id is smaller than any other; where all holders' ids are null, or
several rows share the largest id, all of these keep the line. A line repeated inside the
document that keeps it stays repeated. Other columns of the input, whatever their names, are
left out; an empty table gives no rows. Texts are read whole, a line of any length is one key.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rillet.llm.staging import staged
from rillet.llm.words import LOWER, mix, pieces

MIN_CHARS = 20
MIN_DOCUMENTS = 3
#: Keys of a shard (about 25 bytes each once built, 60 while building).
SHARD_KEYS = 500_000
#: Shards up to this many bytes in all are sent to every worker; beyond it, lines go to the shards.
BROADCAST_BYTES = 32 << 20
#: Hashes that one task probes when lines go to the shards.
CELL_ROWS = 1_000_000
#: Bits of a level for each key still without a place.
GAMMA = 2

SPACE = b" \t\n\x0b\x0c\r"
_LOWER = LOWER.tobytes()
_U = np.uint64


# ------------------------------------------------------------------ line keys
def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[int], list[bytes]]:
    """(the lines, the numbers of those that have a key, their 16-byte hashes)."""
    at, hashes = [], []
    for i, line in enumerate(text.translate(_LOWER).split(b"\n")):
        key = line.strip(SPACE)
        # a code point has one to four bytes
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            at.append(i)
            hashes.append(xxhash.xxh3_128_digest(key))
    return text.split(b"\n"), at, hashes


def halves(hashes: list[bytes]) -> np.ndarray:
    """The two 64-bit halves of each hash, one row a hash."""
    return np.frombuffer(b"".join(hashes), dtype="<u8").astype(_U).reshape(-1, 2)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


# -------------------------------------------------------- minimal perfect hash
class MinimalPerfectHash:
    """Distinct pairs of 64-bit numbers to 0..n-1, as levels of bit arrays.

    In a level each remaining key has one place; keys alone on theirs set its bit, the others
    go on to the next level. A key's number is the count of bits set before its own.
    """

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        ones = [np.bitwise_count(b).astype(np.int64) for b in bits]
        start = np.cumsum([0, *(int(o.sum()) for o in ones)])
        self.before = [s + np.cumsum(o) - o for s, o in zip(start, ones, strict=False)]

    @staticmethod
    def _place(pairs: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(pairs[:, 0] ^ mix(pairs[:, 1] + _U(level + 1))) % _U(size)

    @classmethod
    def build(cls, pairs: np.ndarray) -> MinimalPerfectHash:
        bits, left = [], pairs
        while len(left):
            size = 64 * -(-GAMMA * len(left) // 64)
            at = cls._place(left, len(bits), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            packed = np.packbits(alone.reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1)
            bits.append(packed.astype(_U))
            left = left[~alone[at.astype(np.int64)]]
        return cls(bits)

    def number(self, pairs: np.ndarray) -> np.ndarray:
        """Each pair's number; a pair that was not built in gets any number, or -1."""
        out = np.full(len(pairs), -1, np.int64)
        open_ = np.arange(len(pairs))
        for level, bits in enumerate(self.bits):
            if not len(open_):
                break
            at = self._place(pairs[open_], level, 64 * len(bits))
            word, bit = (at >> _U(6)).astype(np.int64), at & _U(63)
            hit = (bits[word] >> bit) & _U(1) == 1
            low = bits[word[hit]] & ((_U(1) << bit[hit]) - _U(1))
            out[open_[hit]] = self.before[level][word[hit]] + np.bitwise_count(low)
            open_ = open_[~hit]
        return out


class Shard:
    """A perfect hash with, by slot, the key's fingerprint, number of documents and largest id."""

    def __init__(self, index: MinimalPerfectHash, prints: np.ndarray, counts: np.ndarray, largest: np.ndarray):
        self.index, self.prints, self.counts, self.largest = index, prints, counts, largest

    @classmethod
    def build(cls, pairs: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> Shard:
        index = MinimalPerfectHash.build(pairs)
        order = np.argsort(index.number(pairs), kind="stable")
        return cls(index, pairs[order, 1], counts[order], largest[order])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, prints=self.prints, counts=self.counts, largest=self.largest, *self.index.bits)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data), allow_pickle=False) as kept:
            n = sum(name.startswith("arr_") for name in kept.files)
            bits = [kept[f"arr_{i}"] for i in range(n)]
            return cls(MinimalPerfectHash(bits), kept["prints"], kept["counts"], kept["largest"])

    def probe(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of documents, largest id) of each pair; 0 documents: not indexed."""
        at = self.index.number(pairs)
        known = at >= 0
        known[known] = self.prints[at[known]] == pairs[known, 1]
        counts, largest = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        counts[known], largest[known] = self.counts[at[known]], self.largest[at[known]]
        return counts, largest


def _shard_of(pairs: np.ndarray, n: int) -> np.ndarray:
    return (mix(pairs[:, 0]) % _U(n)).astype(np.int64)


# ---------------------------------------------------------------------- Spark
def _repeated(docs: DataFrame, min_chars: int, min_documents: int) -> tuple[DataFrame, int]:
    """(a, b, n, largest) of the hashes found in enough documents, and the number of all (document, key) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, owner = [], []
            for i, text in enumerate(_texts(batch)):
                own = set(line_keys(text, min_chars)[2]) if text else ()
                hashes += own
                owner += [i] * len(own)
            pairs = halves(hashes).view(np.int64)
            ids = batch.column("doc_id").take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), ids], ["a", "b", "doc_id"])

    seen = Observation()
    counted = docs.mapInArrow(run, "a long, b long, doc_id long").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("largest")
    )
    counted = counted.observe(seen, F.sum("n").alias("pairs")).where(f"n >= {int(min_documents)} AND largest IS NOT NULL")
    repeated = staged(counted, "repeated-lines")
    return repeated, int(seen.get["pairs"] or 0)


def _build(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, arrays, bytes, documents): one row for each shard that has keys."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.stack([batch.column(c).to_numpy().view(_U) for c in ("a", "b")], 1)
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(pairs, shards)), *batch.columns], ["shard", *batch.schema.names])

    def build(table: pa.Table) -> pa.Table:
        pairs = np.stack([table.column(c).to_numpy().view(_U) for c in ("a", "b")], 1)
        n = table.column("n").to_numpy()
        data = Shard.build(pairs, n, table.column("largest").to_numpy()).dump()
        return pa.table(
            {"shard": table.column("shard")[:1], "arrays": pa.array([data], pa.binary()),
             "bytes": pa.array([len(data)], pa.int64()), "documents": pa.array([int(n.sum())], pa.int64())}
        )

    dealt = repeated.mapInArrow(deal, "shard long, a long, b long, n long, largest long")
    return staged(dealt.groupBy("shard").applyInArrow(build, "shard long, arrays binary, bytes long, documents long"), "line-index")


OUT = "doc_id long, text string, n_lines long, n_dropped long"


def _kept(ids: list, texts: list[bytes | None], dropped: list) -> pa.RecordBatch:
    """The documents without their ``dropped`` lines (numbers)."""
    out, lines, gone = [], [], []
    for text, drop in zip(texts, dropped, strict=True):
        own = (text or b"").split(b"\n")
        lines.append(len(own))
        gone.append(len(drop))
        if drop:
            drop = set(drop)
            out.append(b"\n".join(x for i, x in enumerate(own) if i not in drop))
        else:
            out.append(text or b"")
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())],
        ["doc_id", "text", "n_lines", "n_dropped"],
    )


def _must_go(shard: Shard, pairs: np.ndarray, ids: np.ndarray, has_id: np.ndarray) -> np.ndarray:
    counts, largest = shard.probe(pairs)
    return (counts > 0) & ~(has_id & (largest == ids))


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _in_scan(docs: DataFrame, index: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """All shards, proven to be small, at every worker."""
    rows = index.select("shard", "arrays").collect()  # at most BROADCAST_BYTES, checked by the caller
    sent = docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.arrays) for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {k: Shard.load(v) for k, v in sent.value.items()}
        for batch in pieces(batches):
            texts = _texts(batch)
            line, owner, hashes = [], [], []
            for i, text in enumerate(texts):
                if text:
                    _, at, own = line_keys(text, min_chars)
                    line += at
                    owner += [i] * len(at)
                    hashes += own
            dropped = [[] for _ in texts]
            if hashes:
                pairs, owner = halves(hashes), np.array(owner)
                ids, has_id = _ids(batch.column("doc_id"))
                place = _shard_of(pairs, shards)
                for k in np.unique(place):
                    if k in loaded:
                        own = np.flatnonzero(place == k)
                        who = owner[own]
                        for j in own[_must_go(loaded[k], pairs[own], ids[who], has_id[who])]:
                            dropped[owner[j]].append(line[j])
            yield _kept(batch.column("doc_id"), texts, dropped)

    return docs.mapInArrow(run, OUT)


def _by_shard(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, pairs: int) -> DataFrame:
    """Hashes travel to cells of their shard, what must go comes back to its document."""
    key = ["doc_id", "row_a", "row_b"]
    docs = docs.withColumns({"row_a": F.xxhash64("text"), "row_b": F.xxhash64(F.lit(1), "text")})
    # a shard's cells follow from its documents and its share of the lines that are not indexed
    sizes = index.select("shard", F.ceil((F.col("documents") + F.lit(pairs / shards)) / CELL_ROWS).alias("cells")).collect()
    cells = np.zeros(shards, np.int64)
    for r in sizes:  # one number a shard
        cells[r.shard] = r.cells

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, owner = [], []
            for i, text in enumerate(_texts(batch)):
                own = set(line_keys(text, min_chars)[2]) if text else ()
                hashes += own
                owner += [i] * len(own)
            both, owner = halves(hashes), np.array(owner, np.int64)
            place = _shard_of(both, shards)
            asked = np.flatnonzero(cells[place] > 0)
            both, owner, place = both[asked], owner[asked], place[asked]
            whose = [batch.column(c).take(pa.array(owner)) for c in key]
            salt = whose[1].to_numpy().view(_U) % cells[place].astype(_U)
            signed = np.ascontiguousarray(both).view(np.int64)
            columns = [place, salt.astype(np.int64), signed[:, 0], signed[:, 1]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), *whose], ["shard", "cell", "a", "b", *key])

    def judge(asked: pa.Table, shard: pa.Table) -> pa.Table:
        asked = asked.combine_chunks()
        both = np.stack([asked.column(c).to_numpy().view(_U) for c in ("a", "b")], 1)
        ids, has_id = _ids(asked.column("doc_id").combine_chunks())
        go = _must_go(Shard.load(shard.column("arrays")[0].as_py()), both, ids, has_id) if len(both) else np.empty(0, bool)
        return asked.select([*key, "a", "b"]).filter(pa.array(go))

    asked = docs.mapInArrow(ask, "shard long, cell long, a long, b long, doc_id long, row_a long, row_b long")
    copied = index.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("documents") + F.lit(pairs / shards)) / CELL_ROWS) - 1)))
    found = asked.groupBy("shard", "cell").cogroup(copied.select("shard", "cell", "arrays").groupBy("shard", "cell")).applyInArrow(
        judge, "doc_id long, row_a long, row_b long, a long, b long"
    )
    # rows with the same id and text have the same answer; of a document only its own lines meet
    gone = found.distinct().groupBy(*key).agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    same = [docs[c].eqNullSafe(gone[c]) for c in key]
    told = docs.join(gone, same, "left").select(docs["doc_id"], docs["text"], gone["gone"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, dropped = _texts(batch), []
            for text, out in zip(texts, batch.column("gone").to_pylist(), strict=True):
                _, at, hashes = line_keys(text, min_chars) if out else (None, [], [])
                out = {(x["a"], x["b"]) for x in out or ()}
                signed = halves(hashes).view(np.int64).tolist()
                dropped.append([i for i, pair in zip(at, signed, strict=True) if tuple(pair) in out])
            yield _kept(batch.column("doc_id"), texts, dropped)

    return told.mapInArrow(drop, OUT)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document without the lines that others repeat.

    A line's key of at least ``min_chars`` code points found in at least ``min_documents``
    documents stays in the one with the largest doc_id only.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated, pairs = _repeated(docs, min_chars, min_documents)
    shards = max(1, -(-repeated.count() // SHARD_KEYS))
    index = _build(repeated, shards)
    size = index.agg(F.sum("bytes")).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return _in_scan(docs, index, shards, min_chars)
    return _by_shard(docs, index, shards, min_chars, pairs)


def digest(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
