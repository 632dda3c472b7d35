"""Language identification as a mixture: expectation-maximisation over each document's words.

Model: hashed letter trigrams (word borders included) counted per language in Spark over a
bounded sample of labelled documents; at most ``BUCKETS`` rows per language reach the driver.

Prediction: a word's likelihood under a language is the product of its trigrams'. EM finds
the language proportions of the document that maximise the likelihood of its words. The
language set is then chosen by penalised likelihood: a language is dropped for as long as
that lowers the likelihood by less than the penalty for one more proportion. The largest
remaining proportion gives ``lang_pred`` and ``score``.

Defined cases: null text and texts without letters are ``und`` with score 0; ties go to the
language that sorts first; with no labelled document at all everything is ``und``. Only the
text of a document is read for its prediction. Long texts are read in pieces, so memory is
bounded by a document's words times the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillet.llm.words import give_back

BUCKETS = 1 << 16
#: Labelled documents read per language, at most (chosen by a hash of their id).
SAMPLE_PER_LANGUAGE = 1500
PIECE = 1 << 20
EM_STEPS = 12
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    #: log probability of a trigram bucket in each language: (BUCKETS, languages)
    log_p: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(trigram bucket of each letter, number of the word it is in); border of a word: 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(len(codes) + 2, bool)
    letter[1:-1] = _letters()[codes]
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = np.where(letter[1:-1], codes, 0)
    at = np.flatnonzero(letter)
    hashed = padded[at - 1] * np.uint32(0x9E3779B1) + padded[at] * np.uint32(0x85EBCA77) + padded[at + 1] * np.uint32(0xC2B2AE3D)
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    word = np.cumsum(~letter[at - 1]) - 1
    return (hashed >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1), word


def _bucket_counts():
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                for piece in _cut(text.lower()):
                    buckets, counts = np.unique(_trigrams(piece)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "bucket": buckets, "n": counts})

    return run, "lang string, bucket long, n long"


def _cut(text: str) -> Iterator[str]:
    """Pieces of about ``PIECE`` characters that end between words (a longer word is cut)."""
    at = 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        if to < len(text):
            back = to
            while back > at and text[back - 1].isalpha() and to - back < PIECE // 2:
                back -= 1
            to = back if back > at and not text[back - 1].isalpha() else to
        yield text[at:to]
        at = to


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """The model of the labelled rows (doc_id, text, lang); rows with a null text or lang are left out."""
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    # Ids with a hash below twice their language's share; of these the smallest, so no task ranks a whole language.
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    share = ids.groupBy("lang").agg((F.lit(2.0 * per_language) / F.count(F.lit(1))).alias("share"))
    few = ids.join(F.broadcast(share), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 < F.col("share"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    sample = usable.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").select("lang", "text")
    rows = sample.mapInPandas(*_bucket_counts()).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    column = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)), np.float64)
    for r in rows:
        counts[r["bucket"], column[r["lang"]]] = r["n"]
    smooth = 0.1
    p = (counts + smooth) / (counts.sum(axis=0) + smooth * BUCKETS)
    return Model(languages, np.log(p).astype(np.float32))


def mixtures(texts: pd.Series, model: Model) -> pd.DataFrame:
    """Per text: (best language or ``und``, its proportion, the chosen set, joined by commas)."""
    likelihoods, sizes = [], []
    for text in texts:
        n = 0
        for piece in _cut(text.lower()) if isinstance(text, str) else ():
            buckets, word = _trigrams(piece)
            if len(word):
                start = np.flatnonzero(np.diff(word, prepend=-1))
                likelihoods.append(np.add.reduceat(model.log_p[buckets], start, axis=0))
                n += len(start)
        sizes.append(n)
    sizes = np.array(sizes, np.int64)
    best = np.full(len(sizes), UNDETERMINED, object)
    score, chosen = np.zeros(len(sizes)), np.full(len(sizes), "", object)
    full = np.flatnonzero(sizes)
    if len(full) and model.languages:
        share, active = _estimate(np.concatenate(likelihoods), sizes[full])
        names = np.array(model.languages, object)
        best[full] = names[share.argmax(axis=1)]
        score[full] = share.max(axis=1)
        chosen[full] = [",".join(names[x]) for x in active]
    return pd.DataFrame({"lang_pred": best, "score": score, "languages": chosen})


def _estimate(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and chosen set of each document, from its words' log likelihoods."""
    start = np.cumsum(sizes) - sizes
    peak = words.max(axis=1, keepdims=True)
    like = np.exp(words - peak).astype(np.float32)
    n_docs, n_lang = len(sizes), words.shape[1]
    active = np.ones((n_docs, n_lang), bool)

    def fit(active: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        share = active / active.sum(axis=1, keepdims=True)
        for _ in range(steps):
            part = like * np.repeat(share.astype(np.float32), sizes, axis=0)
            whole = part.sum(axis=1, keepdims=True) + np.float32(1e-30)
            share = np.add.reduceat(part / whole, start, axis=0) / sizes[:, None]
            share = share / share.sum(axis=1, keepdims=True)
        mixed = np.einsum("ij,ij->i", like, np.repeat(share.astype(np.float32), sizes, axis=0))
        return share, np.add.reduceat(np.log(mixed + 1e-30), start)

    share, fitted = fit(active, EM_STEPS)
    penalty = 0.5 * np.log(np.maximum(sizes, 2)) + np.log(10.0)
    for _ in range(n_lang - 1):
        several = active.sum(axis=1) > 1
        if not several.any():
            break
        least = np.where(active, share, 2.0).argmin(axis=1)
        fewer = active.copy()
        fewer[np.flatnonzero(several), least[several]] = False
        trial, value = fit(fewer, 3)
        drop = several & (fitted - value < penalty)
        if not drop.any():
            break
        active[drop], share[drop], fitted[drop] = fewer[drop], trial[drop], value[drop]
    return share, active


def predictor(model: Model):
    @F.pandas_udf("lang_pred string, score double, languages string")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out, at, size = [], 0, 0
        lengths = texts.str.len().fillna(0).to_numpy()
        for i, n in enumerate(lengths):  # a bounded number of characters at a time
            size += n
            if size > PIECE or i + 1 == len(lengths):
                out.append(mixtures(texts.iloc[at : i + 1], model))
                at, size = i + 1, 0
        found = pd.concat(out) if out else mixtures(texts, model)
        give_back()
        return found

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages; learned from the rows that aren't held out."""
    model = train(docs.where(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), predictor(model)("text").alias("p")).select(
        "doc_id", "held_out", "p.*"
    )
