"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from exact patterns and always stay. Candidates for
further kinds (keys, tokens, passwords, identity numbers, IBANs) come from loose patterns.
Labelers vote on every candidate: its pattern's shape, gazetteers (key prefixes, domain
endings) and the context (cue words before it). Three steps on Spark:

1. one scan finds base spans and candidates with votes; the result is staged (it holds no text);
2. the vote and feature patterns are counted over all documents (a bounded number of groups);
   expectation-maximisation over these counts estimates each labeler's reliability and every
   pattern's probability of being personal data (labelers independent given the truth);
3. a logistic span classifier is fitted to those probabilities on the candidates' features and
   decides each candidate. Accepted spans that overlap a base span or an earlier one are dropped.

Defined cases: null and empty texts have no spans; repeated rows stay; texts are read whole,
in time linear in their length for the base kinds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.llm.staging import staged

BASE_KINDS = ["email", "ip", "card", "phone"]
#: Kinds that the method adds, in the order in which ties are listed.
ADDED_KINDS = ["key", "token", "password", "idnumber", "iban"]
KINDS = BASE_KINDS + ADDED_KINDS

# The base patterns, without steps back, so that one long run takes linear time.
#: An address from its @ on; what stands before it is read backwards.
EMAIL_END = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
EMAIL_START = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits that starts no address starts none from any later digit either.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
#: Loose patterns of candidates; group "v" is the span.
CANDIDATES = [
    ("key", re.compile(r"(?<![A-Za-z0-9_-])(?P<v>(?:[A-Z]{4}|[a-z]{2,3}[_-]|[A-Za-z]{3,5}[_-][a-z]{2,5}[_-])[A-Za-z0-9]{16,})(?![A-Za-z0-9])")),
    ("token", re.compile(r"(?i:\b(?P<cue>[a-z_]*(?:token|secret|key|bearer|auth))\b)\s*[=:]\s*[\"']?(?P<v>[A-Za-z0-9_./+-]{8,}={0,2})")),
    ("password", re.compile(r"(?i:\b(?P<cue>password|passwd|pwd|passphrase|contraseña|passwort)\b)\s*[=:]\s*[\"']?(?P<v>[^\s\"',;]{4,})")),
    ("idnumber", re.compile(r"(?<![0-9-])(?P<v>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])(?P<v>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
]
#: A candidate of a kind can only be where one of these strings is.
_NEEDS = {"key": None, "token": ("=", ":"), "password": ("=", ":"), "idnumber": ("-",), "iban": None}
#: Kinds whose pattern needs a digit.
_WITH_DIGIT = {"idnumber", "iban"}

# Gazetteers.
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "pk_live_", "rk_live_")
CUES = ("token", "secret", "key", "password", "passwd", "pwd", "auth", "bearer", "credential", "login", "ssn", "iban", "account", "id")
IBAN_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")

LABELERS = ["shape", "gazetteer", "context", "entropy", "plain"]
FEATURES = ["long", "hex", "digits", "mixed_case", "quoted", "cue", "prefix"]
#: An added span needs this probability.
ACCEPT = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each holds one @, and no character before it is read twice."""
    last, at = 0, text.find("@")
    while at >= 0:
        end = EMAIL_END.match(text, at)
        start = at
        if end:
            while start > last and text[start - 1] in EMAIL_START:
                start -= 1
        if start < at:
            last = end.end()
            yield start, last
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as listed, end) of the base kinds, sorted; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(start, 0, end) for start, end in _emails(text)]
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [x.lstrip("0") or "0" for x in m[0].split(".")]
            if all(len(x) <= 3 and int(x) <= 255 for x in parts):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _iban_valid(value: str) -> bool:
    plain = value.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _votes(kind: str, value: str, before: str) -> list[int]:
    """Each labeler's vote: 1 personal or secret, -1 not, 0 no opinion."""
    letters, digits = sum(c.isalpha() for c in value), sum(c.isdigit() for c in value)
    spread = len(set(value)) / max(len(value), 1)
    low = before.lower()
    if kind == "idnumber":
        shape = -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" else 1
        gazetteer = 0
    elif kind == "iban":
        shape = 1 if 15 <= len(value.replace(" ", "")) <= 34 and _iban_valid(value) else -1
        gazetteer = 1 if value[:2] in IBAN_COUNTRIES else -1
    else:
        shape = 1 if letters and digits and len(value) >= 12 else -1
        gazetteer = 1 if value.startswith(KEY_PREFIXES) else 0
    context = 1 if any(c in low for c in CUES) else (0 if kind == "key" else -1)
    entropy = 1 if digits >= 4 and spread >= 0.25 else -1
    plain = -1 if not digits or spread < 0.15 else 0
    return [shape, gazetteer, context, entropy, plain]


def _features(value: str, before: str, after: str) -> list[int]:
    return [
        int(len(value) >= 16),
        int(all(c in "0123456789abcdef" for c in value)),
        int(sum(c.isdigit() for c in value) >= 4),
        int(value.lower() != value and value.upper() != value),
        int(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before) and bool(after)),
        int(any(c in before.lower() for c in CUES)),
        int(value.startswith(KEY_PREFIXES)),
    ]


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, votes, features) of each candidate; votes base 3, features as bits."""
    out = []
    for kind, pattern in CANDIDATES:
        needs = _NEEDS[kind]
        if (kind in _WITH_DIGIT and not _DIGIT.search(text)) or (needs and not any(c in text for c in needs)):
            continue
        for m in pattern.finditer(text):
            value, start, end = m["v"], m.start("v"), m.end("v")
            before, after = text[max(0, start - 40) : start], text[end : end + 1]
            votes = sum((v + 1) * 3**i for i, v in enumerate(_votes(kind, value, before)))
            bits = sum(b << i for i, b in enumerate(_features(value, before, after)))
            out.append((start, KINDS.index(kind), end, votes, bits))
    return out


FOUND = (
    "base array<struct<start: long, kind: int, end: long>>, "
    "candidates array<struct<start: long, kind: int, end: long, votes: int, features: int>>"
)


def _finder():
    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        base, more = [], []
        for text in texts:
            text = text if isinstance(text, str) else ""
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in base_spans(text)])
            more.append([dict(zip(("start", "kind", "end", "votes", "features"), c, strict=True)) for c in candidates(text)])
        return pd.DataFrame({"base": base, "candidates": more})

    return find


def estimate(patterns: list[tuple[int, int, int]], steps: int = 50) -> dict[tuple[int, int], float]:
    """EM over counted votes: the probability that (kind, votes) is personal, and thereby reliabilities.

    ``patterns``: (kind, votes, count). A labeler's reliability is the share of its votes that are
    right; no opinion says nothing about the truth. Labelers start right 4 times in 5 and stay
    better than chance, so that the two classes can't change places.
    """
    if not patterns:
        return {}
    kinds, votes, counts = (np.array(x) for x in zip(*patterns, strict=True))
    vote = np.stack([votes // 3**i % 3 for i in range(len(LABELERS))], axis=1) - 1  # -1, 0 or 1
    right = np.full(len(LABELERS), 0.8)
    prior = {k: 0.5 for k in set(kinds)}
    p = np.full(len(kinds), 0.5)
    for _ in range(steps):
        odds = np.log([prior[k] / (1 - prior[k]) for k in kinds]) + vote @ np.log(right / (1 - right))
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        for k in prior:
            here = kinds == k
            prior[k] = (p[here] @ counts[here] + 2) / (counts[here].sum() + 4)
        agreed = np.where(vote > 0, p[:, None], 1 - p[:, None]) * (vote != 0)
        right = (counts @ agreed + 8) / (counts @ (vote != 0) + 10)
        right = np.clip(right, 0.6, 0.98)
    return {(int(k), int(v)): float(x) for k, v, x in zip(kinds, votes, p, strict=True)}


def _design(kinds: np.ndarray, features: np.ndarray) -> np.ndarray:
    bits = features[:, None] >> np.arange(len(FEATURES)) & 1
    own = kinds[:, None] == np.arange(len(BASE_KINDS), len(KINDS))
    return np.concatenate([own, bits], axis=1).astype(float)


def fit(rows: list[tuple[int, int, int, int]], soft: dict[tuple[int, int], float]) -> np.ndarray:
    """Weights of the logistic span classifier from (kind, votes, features, count) and soft labels."""
    weights = np.zeros(len(ADDED_KINDS) + len(FEATURES))
    if not rows:
        return weights
    kinds, votes, features, counts = (np.array(x) for x in zip(*rows, strict=True))
    x, y = _design(kinds, features), np.array([soft[(int(k), int(v))] for k, v in zip(kinds, votes, strict=True)])
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counts * (y - p)) - 0.01 * weights
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(weights))
        weights = weights + np.clip(np.linalg.solve(curve, slope), -4, 4)
    return weights


def find_spans(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every row's base spans and candidates, staged: ``id_col``, base, candidates."""
    return staged(docs.select(id_col, _finder()("text").alias("f")).select(id_col, "f.*"), "pii")


def train(found: DataFrame) -> np.ndarray:
    """Classifier weights from all candidates; only counts per pattern reach the driver.

    Patterns are bounded: kinds x 3^labelers votes x 2^features.
    """
    one = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.features").count()
    rows = [(r["kind"], r["votes"], r["features"], r["count"]) for r in one.collect()]
    by_vote: dict[tuple[int, int], int] = {}
    for kind, votes, _, n in rows:
        by_vote[kind, votes] = by_vote.get((kind, votes), 0) + n
    return fit(rows, estimate([(k, v, n) for (k, v), n in sorted(by_vote.items())]))


def decide(base: list, extra: list, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans of a text, (start, kind, end), sorted: its base spans and the accepted candidates.

    ``base``: (start, kind, end); ``extra``: (start, kind, end, votes, features).
    """
    kept = list(base)
    if extra:
        # What is covered so far, as disjoint ranges in order.
        starts: list[int] = []
        ends: list[int] = []
        for start, _, end in sorted(base):
            if ends and start < ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        kinds, bits = np.array([c[1] for c in extra]), np.array([c[4] for c in extra])
        p = 1 / (1 + np.exp(-(_design(kinds, bits) @ weights)))
        for (start, kind, end, *_), x in sorted(zip(extra, p, strict=True), key=lambda y: (-y[1], y[0][0], y[0][1])):
            i = bisect_right(starts, start)
            if x >= ACCEPT and (i == 0 or ends[i - 1] <= start) and (i == len(starts) or end <= starts[i]):
                kept.append((start, kind, end))
                starts.insert(i, start)
                ends.insert(i, end)
    return sorted(kept)


def accepted(weights: np.ndarray) -> Column:
    """All spans of a staged row: array of (start, kind, end)."""
    fields, more = ("start", "kind", "end"), ("start", "kind", "end", "votes", "features")

    @F.pandas_udf("array<struct<start: long, kind: int, end: long>>")
    def spans(base: pd.Series, extra: pd.Series) -> pd.Series:
        out = []
        for own, found in zip(base, extra, strict=True):
            all_ = decide([tuple(s[f] for f in fields) for s in own], [tuple(c[f] for f in more) for c in found], weights)
            out.append([dict(zip(fields, s, strict=True)) for s in all_])
        return pd.Series(out)

    return spans("base", "candidates")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(docs: DataFrame) -> DataFrame:
    found = find_spans(docs)
    spans = found.select("doc_id", "base", accepted(train(found)).alias("spans"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return spans.select(
        "doc_id", *[count(k) for k in range(4)], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; all columns stay, n_chars follows.

    The classifier is trained on ``docs``; spans are found again in the second scan, so texts
    are never joined or shuffled.
    """
    weights = train(find_spans(docs.select(F.lit(0).alias("doc_id"), "text")))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if isinstance(text, str):
                parts, at = [], 0
                for start, kind, end in decide(base_spans(text), candidates(text), weights):
                    if start >= at:  # base spans of different kinds may overlap
                        parts += [text[at:start], f"<{KINDS[kind]}>"]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    columns = docs.columns
    out = docs.withColumn("text", clean("text"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
