"""Quality rules as a bitmask ledger (built-in column functions only).

Every rule is evaluated once per document. Its failure is one bit of ``failed_bits`` and
its inputs stay as measurements, so a policy (a named, versioned set of rules) is applied
later with one bitwise AND, and ablations of a policy are sums over those bits.

Defined cases: null or empty text has no words (fails ``too_few_words``, 0 measurements);
repeated rows and null ids are kept as they are; an empty table gives an empty ledger;
columns whose names clash with the ledger's are dropped from the ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """One rule: its bit in the ledger and the condition on a row's measurements under which it fails."""

    name: str
    bit: int
    fails: Callable[[Column], Column]


def _over(part: str, percent: int, whole: str) -> Callable[[Column], Column]:
    return lambda m: F.lit(100) * m[part] > F.lit(percent) * m[whole]


#: Bits are never reused: a new version of a rule takes a new bit.
RULES = [
    Rule("too_few_words", 0, lambda m: m["n_words"] < 10),
    Rule("repeated_windows", 1, _over("n_repeat_words", 20, "n_words")),
    Rule("symbol_share", 2, _over("n_symbols", 25, "word_chars")),
    Rule("repeated_lines", 3, _over("n_dup_lines", 50, "n_lines")),
    Rule("long_words", 4, lambda m: m["word_chars"] > 100 * m["n_words"]),
    Rule("strict_symbol_share", 5, _over("n_symbols", 10, "word_chars")),
    Rule("strict_repeated_lines", 6, _over("n_dup_lines", 20, "n_lines")),
]

#: Policies name the rules they use; a published version never changes.
POLICIES = {
    "base-1": ["too_few_words", "repeated_windows"],
    "standard-1": ["too_few_words", "repeated_windows", "symbol_share", "repeated_lines", "long_words"],
    "strict-1": [r.name for r in RULES],
}
DEFAULT_POLICY = "standard-1"


def mask_of(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, also where lambdas inside use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more.

    Equal windows have equal hashes, so only texts with a repeated hash go on to compare the
    windows themselves: sorted with their positions, a repeated one equals a neighbour.
    """
    last = F.size(words) - WINDOW

    def window(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i + j) for j in range(WINDOW)]

    def covered(sorted_windows: Column) -> Column:
        at = lambda k: F.get(sorted_windows, k)["words"]
        places = F.sort_array(
            F.filter(
                F.transform(
                    sorted_windows,
                    lambda x, k: F.when(
                        F.coalesce(at(k - 1) == x["words"], F.lit(False))
                        | F.coalesce(at(k + 1) == x["words"], F.lit(False)),
                        x["place"],
                    ),
                ),
                lambda p: p.isNotNull(),
            )
        )
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            places,
            start,
            lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
            ),
            lambda acc: acc["n"],
        )

    def exact(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.struct(F.array(*window(w, i)).alias("words"), i.alias("place")),
        )
        return _let(F.sort_array(windows), covered)

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*window(w, i)))
        repeated = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(repeated, exact(w)).otherwise(F.lit(0).cast("long"))

    return F.when(last < 1, F.lit(0).cast("long")).otherwise(_let(words, count))


def entry(text: Column) -> Column:
    """One text's ledger entry: a struct of the measurements and ``failed_bits``, computed once."""
    whole = F.coalesce(text, F.lit(""))
    has_word = lambda line: F.length(F.translate(line, SPACES, "")) > 0
    lines = F.filter(F.split(whole, "\n", -1), has_word)
    words = F.filter(F.split(F.translate(whole, SPACES, " " * len(SPACES)), " ", -1), lambda w: w != "")
    in_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    in_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeated")))
    measured = _let(
        F.struct(in_words.alias("w"), in_lines.alias("l")),
        lambda x: F.struct(
            x["w"]["n"].cast("long").alias("n_words"),
            F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (x["l"]["n"] - x["l"]["distinct"]).cast("long").alias("n_dup_lines"),
            x["w"]["repeated"].alias("n_repeat_words"),
            x["l"]["n"].cast("long").alias("n_lines"),
        ),
    )

    def judged(m: Column) -> Column:
        bits = F.lit(0).cast("long")
        for rule in RULES:
            bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
        return F.struct(*[m[c].alias(c) for c in [*MEASURES, "n_lines"]], bits.alias("failed_bits"))

    return _let(measured, judged)


def ledger(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, the measurements and ``failed_bits`` (bit r.bit is set where rule r fails)."""
    return docs.select(id_col, entry(F.col(text)).alias("_entry")).select(id_col, "_entry.*")


def keep(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The rows, all columns, that the policy keeps; judged in the scan, without a join."""
    failed = _let(entry(F.col(text)), lambda e: e["failed_bits"].bitwiseAND(F.lit(mask_of(policy)).cast("long")))
    return docs.where(failed == 0)


def apply_policy(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``policy``, ``kept`` and ``sole_bit`` (the one failed rule without which it were kept, or 0)."""
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long"))
    return entries.withColumns(
        {
            "policy": F.lit(policy),
            "kept": failed == 0,
            "sole_bit": F.when(F.bit_count(failed) == 1, failed).otherwise(F.lit(0).cast("long")),
        }
    )


def ablations(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, fail it alone, and stay without it.

    The ledger is first counted by its masked bits (at most 2^rules groups, combined map-side).
    """
    mask = mask_of(policy)
    counted = (
        entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rules = F.array(
        *[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if mask >> r.bit & 1]
    )
    n, bits, bit = F.col("n"), F.col("bits"), F.col("bit")
    return (
        counted.select("bits", "n", F.inline(rules))
        .groupBy("rule")
        .agg(
            F.sum(F.when(bits.bitwiseAND(bit) != 0, n).otherwise(0)).alias("n_failed"),
            F.sum(F.when(bits == bit, n).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(bits.bitwiseAND(F.bitwise_not(bit)) == 0, n).otherwise(0)).alias("n_kept_without"),
        )
    )


def digest(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The measurements with ``base_failed`` and ``kept`` under a policy that holds the base rules."""
    base = F.col("failed_bits").bitwiseAND(F.lit(mask_of("base-1")).cast("long")) != 0
    judged = apply_policy(ledger(docs), policy)
    return judged.select(
        "doc_id", *MEASURES, base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed_bits", "sole_bit", "policy"
    )
