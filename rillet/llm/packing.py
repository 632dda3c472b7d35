"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

1. Documents are tokenized once and cut where they exceed a sequence: full pieces and a rest.
   Each piece keeps its length and the checksum of its ids; ids are not moved.
2. The histogram of piece lengths (at most ``capacity`` rows) is planned on the driver. Lengths
   are placed longest first, each into the packs with the most room, and packs of one fill are
   handled together as ranges of sequence ids. A length that leaves packs half used moves on to
   the next fill. The plan is a list of slots: (length, first rank, count, first sequence,
   offset).
3. Pieces are ranked within their length (by salted groups, so a hot length is split) and
   joined to the slots by length and rank.

Padding goes up to the capacity, except that a sequence may stop at a power of two.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an
empty table packs nothing; null ids are kept. Columns other than id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillet.llm.staging import staged
from rillet.llm.words import LETTER, NOT_SPACE, PUNCTUATION, IdCache, pieces, words_of

CAPACITY = 2048
END_ID = 1
#: Slots are broadcast up to this many rows (40 bytes each), else joined by shuffle.
BROADCAST_SLOTS = 500_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts, encoding each distinct word once.

    The tokenizer lower-cases, drops white space, and never joins a letter with punctuation
    other than an apostrophe, so a text's ids are the ids of its parts between such borders.
    Only borders between ASCII characters are cut: anything else may compose or be a symbol.
    The tokenizer's added tokens are matched in plain text, across such borders: texts that hold
    one go through it whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [(t.content, t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = IdCache(self._ids)

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _with_added(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold one of the tokenizer's added tokens (in any case, if it is matched after normalization)."""
        out = np.zeros(len(texts), bool)
        for content, normalized in self.added:
            found = pc.match_substring(texts, content, ignore_case=normalized)
            out |= pc.fill_null(found, False).to_numpy(zero_copy_only=False)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids in each text)."""
        whole = self._with_added(texts)
        at = np.flatnonzero(whole)
        parts = pc.if_else(pa.array(~whole), texts, pa.scalar(None, texts.type)) if len(at) else texts
        ids, counts = self.cache.encode(words_of(parts, NOT_SPACE, cut=[(LETTER, PUNCTUATION), (PUNCTUATION, LETTER)]))
        if len(at):
            own = [np.array(self._ids([texts[i].as_py().encode()])[0], ids.dtype) for i in at.tolist()]
            length = np.array([len(x) for x in own])
            ids = np.insert(ids, np.repeat(np.cumsum(counts)[at], length), np.concatenate(own))
            counts[at] = length
        return ids, counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each piece; every piece but the last is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in pieces(batches):
            ids, counts = encode(batch.column("text"))
            total = counts + 1
            to = np.cumsum(total)
            flat = np.full(int(to[-1]), END_ID, "<u4")
            inside = np.ones(len(flat), bool)
            inside[to - 1] = False
            flat[inside] = ids
            n = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, total[doc] - start)
            begin = (to - total)[doc] + start
            crc = [zlib.crc32(flat[b : b + k]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    pa.array(total[doc]),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset) that place every piece.

    Packs are ranges of sequence ids with one fill. A length takes the least filled packs
    first, as long as it fits; what is left of it opens new packs.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_packs: list[tuple[int, int, int]] = []  # heap of (fill, first sequence, count)
    n_sequences = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left and open_packs and open_packs[0][0] + length <= capacity:
            fill, sequence, count = heappop(open_packs)
            used = min(left, count)
            slots.append((length, rank, used, sequence, fill))
            if fill + length < capacity:
                heappush(open_packs, (fill + length, sequence, used))
            if used < count:
                heappush(open_packs, (fill, sequence + used, count - used))
            rank, left = rank + used, left - used
        while left:
            # New packs take as many pieces of this length as fit, before the shorter ones come.
            fits = capacity // length
            packs = max(1, left // fits) if fits > 1 and left >= fits else left if fits == 1 else 1
            each = min(fits, left)
            for i in range(each):
                slots.append((length, rank, packs, n_sequences, i * length))
                rank, left = rank + packs, left - packs
            if each * length < capacity:
                heappush(open_packs, (each * length, n_sequences, packs))
            n_sequences += packs
    return slots


def pack(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (a staged table) with sequence_id and offset."""
    spark = pieces_.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces_.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan(histogram, capacity)
    schema = "length long, rank long, n long, sequence long, offset long"
    table = spark.createDataFrame(slots, schema)
    table = F.broadcast(table) if len(slots) <= BROADCAST_SLOTS else table
    # Rank within a length: groups by a salt of the piece, then the groups' running total.
    n_salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces_.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_salts)))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = groups.withColumn(
        "base", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "salt", F.coalesce("base", F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"])
    p, s = ranked.withColumn("place", F.col("base") + F.col("own")).alias("p"), table.alias("s")
    inside = (F.col("p.place") >= F.col("s.rank")) & (F.col("p.place") < F.col("s.rank") + F.col("s.n"))
    return p.join(s, (F.col("p.length") == F.col("s.length")) & inside).select(
        *[f"p.{c}" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")],
        (F.col("s.sequence") + F.col("p.place") - F.col("s.rank")).alias("sequence_id"),
        F.col("s.offset").alias("offset"),
    )


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(staged(tokenized_pieces(docs, path or tokenizer_path()), "pieces"))
