"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary's pieces and scores are read as a unigram model: the ids of a text are the
pieces of its best-scored segmentation (ties: the longer last piece), characters without a
piece become bytes. A stream keeps scores for the last ``longest piece`` positions only. A new
piece can start at those positions alone, so as soon as the best paths to all of them run
through one boundary, everything before it is final and its ids are committed.

Scores are whole numbers, so their sums in doubles are exact, wherever a sum starts.

A boundary before a run of spaces is always such a point, since no piece has a space after
another character. Distinct words are therefore encoded once per batch: short ones side by
side, column by column, in numpy (the window of each is the word), long ones as a stream.

Decoding joins the pieces' bytes and drops the space put before the text. Texts come back
exactly, except that U+2581 comes back as a space.

Defined cases: null or empty text has no ids; repeated rows and null ids are kept; a text
without spaces is one stream, with memory bounded by the distance between commits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.llm.words import IdCache, Words, bytes_of, pieces

MARK = "▁"
#: Words up to this many characters are encoded side by side.
SHORT = 48
UNKNOWN_PENALTY = 10.0

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.table: dict[str, tuple[int, float]] = {}
        self.byte_id = [0] * 256
        out = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                out.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                out.append(b"")
            else:
                self.table[piece] = (i, model.get_score(i))
                out.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.table))
        self.unknown = min(s for _, s in self.table.values()) - UNKNOWN_PENALTY
        # Bytes of every id, for decoding.
        self.size = np.array([len(x) for x in out], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        # Hashes of the pieces, for words side by side.
        hashed = [(int(self._hash(p)), i, s) for p, (i, s) in self.table.items()]
        hashed.sort()
        self.hashes = np.array([h for h, _, _ in hashed], _U)
        self.ids = np.array([i for _, i, _ in hashed], np.int64)
        self.scores = np.array([s for _, _, s in hashed])
        self.cache = IdCache(self.encode_words)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = _U(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _BASE + _U(ord(c) + 1)
            return h + _U(len(piece))

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a stream of normalised characters, as they become final."""
        longest, table = self.longest, self.table
        window, start = "", 0  # characters since the last commit, and their position
        best, back = [0.0], [(0, ())]  # by position from ``start``: score; (start, ids) of the last piece
        for at, c in enumerate(chars, 1):
            window += c
            score, origin = None, None
            for length in range(min(longest, at - start), 0, -1):
                piece = table.get(window[-length:])
                if piece is None and length > 1:
                    continue
                ids, own = ((piece[0],), piece[1]) if piece else (self._bytes_of(c), self.unknown)
                total = best[at - length - start] + own
                if score is None or total > score:
                    score, origin = total, (at - length, ids)
            best.append(score)
            back.append(origin)
            if len(window) >= 2 * longest and at % longest == 0:
                # Where do the best paths to all positions that a new piece can start at meet?
                alive = set(range(at - longest + 1, at + 1))
                while len(alive) > 1:
                    last = max(alive)
                    alive.remove(last)
                    alive.add(back[last - start][0])
                border = alive.pop()
                if border > start:
                    yield self._path(back, start, border)
                    # Scores go on from the border's, so that sums are those of one pass.
                    window, best, back = window[border - start :], best[border - start :], back[border - start :]
                    start = border
        if window:
            yield self._path(back, start, start + len(window))

    def _bytes_of(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_id[b] for b in c.encode("utf-8", "surrogatepass"))

    @staticmethod
    def _path(back: list, start: int, end: int) -> list[int]:
        parts = []
        while end > start:
            end, ids = back[end - start]
            parts.append(ids)
        return [i for ids in reversed(parts) for i in ids]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words (each: spaces, then other characters)."""
        texts = [w.decode().replace(" ", MARK) for w in words]
        out: list[list[int]] = [[]] * len(texts)
        short = sorted((i for i, t in enumerate(texts) if len(t) <= SHORT), key=lambda i: -len(texts[i]))
        for at in range(0, len(short), 8192):
            some = short[at : at + 8192]
            for i, ids in zip(some, self._side_by_side([texts[i] for i in some]), strict=True):
                out[i] = ids
        for i, t in enumerate(texts):
            if len(t) > SHORT:
                out[i] = [x for part in self.stream(t) for x in part]
        return out

    def _side_by_side(self, texts: list[str]) -> list[list[int]]:
        """The stream's recurrence, one character of all words (longest first) at a time."""
        n, width = len(texts), len(texts[0])
        lengths = np.array([len(t) for t in texts])
        codes = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), np.uint32).reshape(n, width)
        prefix = np.zeros((width + 1, n), _U)
        powers = np.concatenate([[_U(1)], np.multiply.accumulate(np.full(self.longest, _BASE))])
        best = np.zeros((width + 1, n))
        start = np.zeros((width + 1, n), np.int16)
        chosen = np.full((width + 1, n), -1, np.int64)
        for j in range(1, width + 1):
            m = int(np.searchsorted(-lengths, -j, side="right"))  # words that have a j-th character
            prefix[j, :m] = prefix[j - 1, :m] * _BASE + codes[:m, j - 1].astype(_U) + _U(1)
            score, origin, piece = np.full(m, -np.inf), np.zeros(m, np.int16), np.full(m, -1, np.int64)
            for length in range(min(self.longest, j), 0, -1):
                h = prefix[j, :m] - prefix[j - length, :m] * powers[length] + _U(length)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[at] == h
                total = best[j - length, :m] + np.where(known, self.scores[at], self.unknown if length == 1 else -np.inf)
                better = total > score
                score[better], origin[better] = total[better], j - length
                piece[better] = np.where(known, self.ids[at], -1)[better]
            best[j, :m], start[j, :m], chosen[j, :m] = score, origin, piece
        out = []
        for i, text in enumerate(texts):
            end, parts = len(text), []
            while end:
                begin, piece = int(start[end, i]), int(chosen[end, i])
                parts.append((piece,) if piece >= 0 else self._bytes_of(text[begin]))
                end = begin
            out.append([x for ids in reversed(parts) for x in ids])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids in each text)."""
        return self.cache.encode(spaced_words(texts))

    def encode_text(self, text: str) -> list[int]:
        """Ids of one text, as one stream."""
        return [i for part in self.stream(MARK + text.replace(" ", MARK)) for i in part] if text else []

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, number of bytes in each), with the space before each text."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.first[ids] - (ends - size), size)
        per_text = np.add.reduceat(np.append(size, 0), np.cumsum(counts) - counts) * (counts > 0)
        return self.bytes[at], per_text


def spaced_words(texts: pa.Array) -> Words:
    """Texts, each after one more space, cut before every run of spaces (empty texts: nothing)."""
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
    data, offset = bytes_of(texts)
    full = np.diff(offset) > 0
    shift = np.cumsum(full)
    out = np.full(len(data) + int(full.sum()), 0x20, np.uint8)
    begin = offset[:-1] + shift - full
    row = np.repeat(np.arange(len(full)), np.diff(offset))
    out[np.arange(len(data)) + shift[row]] = data
    space = out == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[begin[full]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(out))[: len(starts)]
    moved = np.append(begin, len(out))
    return Words(len(full), out, moved, starts, ends, np.diff(np.searchsorted(starts, moved)))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process, kept between tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, counts = codec(path).encode(batch.column("text"))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give null, no ids the empty text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                data, _ = codec(path).decode(np.array(ids, np.int64), np.array([len(ids)]))
                texts.append(data.tobytes().decode("utf-8", "replace").removeprefix(" "))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoding gives the text)."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = codec(path)
            words = spaced_words(batch.column("text"))
            ids, counts = own.cache.encode(words)
            ends = np.cumsum(counts)
            flat = ids.astype("<u4")
            crc = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            data, sizes = own.decode(ids.astype(np.int64), counts)
            same = sizes == np.diff(words.offset)
            if len(data) == len(words.data):
                wrong = np.flatnonzero(data != words.data)
                same[np.searchsorted(words.offset, wrong, side="right") - 1] = False
            else:
                begin = np.cumsum(sizes) - sizes
                for i in np.flatnonzero(same):
                    o = words.offset[i]
                    same[i] = np.array_equal(data[begin[i] : begin[i] + sizes[i]], words.data[o : o + sizes[i]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(crc, pa.int64()), pa.array(same)],
                names=["doc_id", "n_ids", "ids_crc32", "round_trip"],
            )

    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
