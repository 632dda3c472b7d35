"""Repair of conversation structure by Knuth's lightest derivations.

A conversation's roles should read ``(s?(ua)+)?`` in their initials: perhaps a system turn, then
user and assistant in turn. A row may be kept (cost 0), given the role due (Rerole, 1) or
deleted (2, the only choice for blank and duplicate rows), and an empty turn of the role due may
be inserted anywhere (5); a truncated row that stays costs 5 more. The cheapest edits win; of
equally cheap ones those whose initials in order (the audit) are least in ASCII.

Method. An item [l, h, p, q] says that the rows l..h lead from state p to state q of the
pattern. Its weight is (cost, audit); a deduction adds costs and joins audits, either of an item
and one edit or of two neighbouring items. The agenda gives out items lightest first, and an
item's first weight is final, until the goal (all rows, from the start to an end of the pattern)
is. Joining to the left could make an audit smaller at the same cost, so items of equal cost
are given out narrow ones first: in the order (cost, width, audit) every deduction is superior.
Insertions stand before a row or at the end of the conversation, not at the end of an item:
audits over the same rows are then never beginnings of each other, and joining keeps their order.

At scale. Equal rows of a conversation become one row with a count, and the first turn of a
text is found by an aggregate. Rows are then range-partitioned in conversation order and read
as a stream, so that a conversation with most of the rows is cut into slices like any other.
Conversations inside a slice are solved there, long ones as blocks of ``BLOCK`` rows joined
pairwise. Only the first and the last conversation of a slice may go on elsewhere: for them a
slice gives the weights of its 4 x 4 items, a conversation's slices are walked by these weights
alone (one row a slice), and its rows and hash follow in a second pass, in pieces of bounded size.

Defined cases: null roles and texts are one space. Turns order a conversation, null first; rows
of the same turn are ordered by role, then text. Repeated rows stay repeated (all but the first
are duplicates). Null ``conv_id`` is a conversation of its own. A conversation without rows left
has zeros and empty results. Roles may be any text; only s, u and a fit the pattern. Other
columns of the input are ignored; an empty table gives no rows. Texts and conversations are
taken whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.llm.staging import staged
from rillet.operators.offsets import join_small, slice_count

#: What edits cost, and the pattern as states (start, after s, after u, after a).
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
GOALS = (START, AFTER_A)
KEPT = {("s", START): AFTER_S, ("u", START): AFTER_U, ("u", AFTER_S): AFTER_U, ("u", AFTER_A): AFTER_U, ("a", AFTER_U): AFTER_A}
DUE = {START: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
LEGAL = ("su", "ua", "au")

SOUND, BLANK, DUPLICATE, CUT = range(4)
SPACE = " \t\n\x0b\x0c\r"

#: Rows of one agenda; longer conversations are joined from blocks of so many rows.
BLOCK = 32
#: Characters of a text of a cut conversation that travel as one row.
PIECE = 1 << 16

Weight = tuple[int, str]
Span = dict[tuple[int, int], Weight]


# -------------------------------------------------------------------- agenda
def lightest(
    axioms: Iterable[tuple[int, int, str, Hashable]],
    deduce: Callable[[Hashable, Weight, dict], Iterable[tuple[int, int, str, Hashable]]],
    goal: Hashable = None,
) -> dict[Hashable, Weight]:
    """The final weights of all items, or of those given out until ``goal`` was.

    Candidates are (cost, width, audit, item). ``deduce(item, weight, final)`` gives the candidates
    that follow from an item and those that are final already.
    """
    agenda, final = list(axioms), {}
    heapq.heapify(agenda)
    while agenda:
        cost, _, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        if item == goal:
            break
        for candidate in deduce(item, final[item], final):
            if candidate[3] not in final:
                heapq.heappush(agenda, candidate)
    return final


def edits(row: tuple[str, int], state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after it) of each edit that takes a row (initial, fault)."""
    initial, fault = row
    yield "D", DELETE, state
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        if (initial, state) in KEPT:
            yield "K", more, KEPT[initial, state]
        yield "R", more + REROLE, DUE[state][1]


def _stepwise(rows: list[tuple[str, int]], ends: bool):
    """Deductions of an item and one edit; items are (p, rows taken, q), the goal is ``None``."""

    def deduce(item, weight, _):
        (p, i, q), (cost, audit) = item, weight
        if i < len(rows):
            for letter, c, to in edits(rows[i], q):
                yield cost + c, i + 1, audit + letter, (p, i + 1, to)
        elif ends and q in GOALS:
            yield cost, i, audit, None
        if i < len(rows) or ends:
            yield cost + INSERT, i, audit + "I", (p, i, DUE[q][1])

    return deduce


def block_spans(rows: list[tuple[str, int]]) -> Span:
    """The weights of a block's items, by (p, q)."""
    final = lightest([(0, 0, "", (p, 0, p)) for p in STATES], _stepwise(rows, False))
    return {(p, q): w for (p, i, q), w in final.items() if i == len(rows)}


def spans(rows: list[tuple[str, int]]) -> Span:
    """The weights of the items over all ``rows``: blocks, joined pairwise by an agenda."""
    blocks = [block_spans(rows[i : i + BLOCK]) for i in range(0, max(len(rows), 1), BLOCK)]
    while len(blocks) > 1:
        blocks = [_join(*blocks[i : i + 2]) if i + 1 < len(blocks) else blocks[i] for i in range(0, len(blocks), 2)]
    return blocks[0]


def _join(left: Span, right: Span) -> Span:
    """Deductions of two neighbouring items: (side, p, q) with sides 0 and 1; their joins have side 2."""
    axioms = [(*w[:1], 1, w[1], (side, *pq)) for side, part in ((0, left), (1, right)) for pq, w in part.items()]

    def deduce(item, weight, final):
        side, p, q = item
        for r in STATES if side < 2 else ():
            other = (1, q, r) if side == 0 else (0, r, p)
            if other in final:
                a, b = (weight, final[other]) if side == 0 else (final[other], weight)
                yield a[0] + b[0], 2, a[1] + b[1], (2, p, r) if side == 0 else (2, r, q)

    return {(p, q): w for (side, p, q), w in lightest(axioms, deduce).items() if side == 2}


def ending(q: int) -> str:
    """The insertions that lead from a state to an end of the pattern."""
    return {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}[q]


def best(rows: list[tuple[str, int]]) -> Weight:
    """(cost, audit) of the cheapest repair of a whole conversation."""
    if len(rows) <= BLOCK:
        return lightest([(0, 0, "", (START, 0, START))], _stepwise(rows, True), None)[None]
    whole = spans(rows)
    ends = [(whole[START, q][0] + INSERT * len(ending(q)), whole[START, q][1] + ending(q)) for q in STATES if (START, q) in whole]
    return min(ends)


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """The (role, text) of the repaired rows."""
    rows = iter(rows)
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "K":
            state = KEPT[role[:1], state]
        elif letter != "D":
            role, state = DUE[state]
        if letter != "D":
            yield role, text


# ------------------------------------------------------------- one run of rows
class Run:
    """The rows of one conversation in one slice, in order."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.rows: list[tuple[str, int]] = []
        self.turns: list[tuple[str, str]] = []
        self.counts = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.first = self.last = None

    def add(self, row: dict) -> None:
        role, turn = row["role"], row["turn"]
        for i in range(row["copies"]):
            fault = row["fault"] if i == 0 or row["fault"] == BLANK else DUPLICATE
            if self.rows and self.rows[-1][0] + role[:1] not in LEGAL:
                self.illegal += 1
            self.rows.append((role[:1], fault))
            self.turns.append((role, row["text"]))
            self.counts[fault] += 1
        if row["copies"] and turn is not None:
            if turn != self.last:
                self.distinct += 1
            self.first = turn if self.first is None else self.first
            self.last = turn

    def state(self) -> dict:
        return {
            "conv_id": self.conv, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE],
            "truncated": self.counts[CUT], "illegal": self.illegal, "distinct": self.distinct,
            "first_turn": self.first, "last_turn": self.last, "n_rows": len(self.rows),
            "first_initial": self.rows[0][0] if self.rows else None, "last_initial": self.rows[-1][0] if self.rows else None,
        }

    def whole(self, texts: bool) -> dict:
        cost, audit = best(self.rows)
        text = "\n".join(f"{role}:{text}" for role, text in repaired(self.turns, audit))
        return {
            **self.state(), "gaps": gaps(self.first, self.last, self.distinct), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(), "repaired": text if texts else None,
        }

    def part(self) -> dict:
        """What the conversation's other slices need: costs, order of audits and audits by 4 p + q."""
        found = spans(self.rows)
        order = {a: i for i, a in enumerate(sorted({w[1] for w in found.values()}))}
        cells = [found.get((p, q)) for p in STATES for q in STATES]
        return {
            **self.state(), "costs": [w and w[0] for w in cells], "ranks": [w and order[w[1]] for w in cells],
            "audits": [w and w[1] for w in cells],
        }


def gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


COUNTS = "blank long, duplicate long, truncated long, illegal long"
TOTALS = f"gaps long, {COUNTS}, cost long"
WHOLE = f"conv_id long, {TOTALS}, audit string, repaired_sha256 string, repaired string"
SEGMENT = (
    f"distinct long, first_turn long, last_turn long, n_rows long, first_initial string, last_initial string, "
    "costs array<long>, ranks array<long>, audits array<string>"
)
ROW = "place long, role string, text string, fault long, copies long"
RUNS = f"kind string, slice long, {WHOLE}, {SEGMENT}, {ROW}"


def _schema(ddl: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(x.split()[0], types[x.split()[1]]) for x in ddl.split(", ")])


def _batches(rows: Iterator[dict], ddl: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``size`` characters."""
    schema, kept, held = _schema(ddl), [], 0
    for row in rows:
        kept.append(row)
        held += 200 + sum(len(v) for v in row.values() if isinstance(v, str))
        if held >= size:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, held = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


def _solve(texts: bool):
    """Whole conversations solved; the first and last of a slice as a segment and its rows."""

    def edge(run: Run, own: list[dict]) -> Iterator[dict]:
        at = own[0]["slice"]
        yield {"kind": "segment", "slice": at, **run.part()}
        for i, row in enumerate(own):
            yield {"kind": "row", "slice": at, "conv_id": run.conv, "place": i, **{c: row[c] for c in ("role", "text", "fault", "copies")}}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        run, own, first = None, [], True
        for batch in batches:
            for row in batch.to_pylist():
                if run is None or row["conv_id"] != run.conv:
                    if run is not None:
                        yield from edge(run, own) if first else [{"kind": "whole", **run.whole(texts)}]
                        first = False
                    run, own = Run(row["conv_id"]), []
                run.add(row)
                own.append(row)
        if run is not None:
            yield from edge(run, own)

    return lambda batches: _batches(each(batches), RUNS)


# -------------------------------------------------- conversations of several slices
PATHS = f"conv long, none boolean, slice long, p long, audit string, {TOTALS}"


def _walk(table: pa.Table) -> pa.Table:
    """A conversation's path through its slices, by costs and the order of audits."""
    parts = sorted(table.to_pylist(), key=lambda r: r["slice"])
    due = [INSERT * len(ending(q)) for q in STATES]
    left = [due]
    for part in reversed(parts):
        costs = part["costs"]
        left.append([min((costs[4 * p + q] + left[-1][q] for q in STATES if costs[4 * p + q] is not None)) for p in STATES])
    left.reverse()
    p, out = START, []
    for part, after in zip(parts, left[1:], strict=True):
        open_ = [q for q in STATES if part["costs"][4 * p + q] is not None]
        q = min(open_, key=lambda q: (part["costs"][4 * p + q] + after[q], part["ranks"][4 * p + q]))
        out.append({"conv": part["conv"], "none": part["none"], "slice": part["slice"], "p": p, "audit": part["audits"][4 * p + q]})
        p = q
    out[-1]["audit"] += ending(p)
    totals = {c: sum(part[c] for part in parts) for c in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    filled = [part for part in parts if part["n_rows"]]
    for a, b in zip(filled, filled[1:], strict=False):
        totals["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    timed = [part for part in parts if part["first_turn"] is not None]
    totals["distinct"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
    first, last = (timed[0]["first_turn"], timed[-1]["last_turn"]) if timed else (None, None)
    distinct = totals.pop("distinct")
    totals |= {"gaps": gaps(first, last, distinct), "cost": left[0][START]}
    return pa.Table.from_pylist([{**row, **totals} for row in out], _path_schema())


def _path_schema() -> pa.Schema:
    return pa.schema([("conv", pa.int64()), ("none", pa.bool_()), *_schema(PATHS.split("boolean, ")[1])])


PIECES = f"conv long, none boolean, slice long, piece long, audit_piece string, text_piece string, turns boolean, {TOTALS}"


def _write(rows: pa.Table, path: pa.Table) -> pa.Table:
    """The repaired rows of one slice of a conversation, as pieces of text; its audit in the first."""
    (at,) = path.to_pylist()
    own = sorted(rows.to_pylist(), key=lambda r: r["place"])
    turns = [(r["role"], r["text"]) for r in own for _ in range(r["copies"])]
    kept = [f"{role}:{text}" for role, text in repaired(turns, at["audit"], at["p"])]
    text = "\n".join(kept)
    same = {c: at[c] for c in ("conv", "none", "slice", *(x.split()[0] for x in TOTALS.split(", ")))}
    out = [
        {**same, "piece": i, "audit_piece": "" if i else at["audit"], "text_piece": text[i * PIECE : (i + 1) * PIECE], "turns": bool(kept)}
        for i in range(max(1, -(-len(text) // PIECE)))
    ]
    totals = _schema(TOTALS)
    schema = pa.schema(
        [("conv", pa.int64()), ("none", pa.bool_()), ("slice", pa.int64()), ("piece", pa.int64()), ("audit_piece", pa.string()),
         ("text_piece", pa.string()), ("turns", pa.bool_()), *totals]
    )
    return pa.Table.from_pylist(out, schema)


def _finish(texts: bool):
    """One row a conversation from its pieces in order: the text runs through the hash, it is not held."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now = done = None
        for batch in batches:
            for row in batch.to_pylist():
                if now != (row["conv"], row["none"]):
                    if done is not None:
                        yield done()
                    now, last, hashed, audit, held, begun = (row["conv"], row["none"]), row, hashlib.sha256(), [], [], False

                    def done(last=last, hashed=hashed, audit=audit, held=held):
                        return {
                            "conv_id": None if last["none"] else last["conv"], **{x.split()[0]: last[x.split()[0]] for x in TOTALS.split(", ")},
                            "audit": "".join(audit), "repaired_sha256": hashed.hexdigest(), "repaired": "".join(held) if texts else None,
                        }

                text = row["text_piece"]
                if row["turns"] and row["piece"] == 0:
                    text, begun = ("\n" if begun else "") + text, True
                hashed.update(text.encode())
                audit.append(row["audit_piece"])
                if texts:
                    held.append(text)
        if done is not None:
            yield done()

    return lambda batches: _batches(each(batches), WHOLE)


# ---------------------------------------------------------------------- Spark
def _judged(rows: DataFrame) -> DataFrame:
    """Equal rows as one with its copies, and the first fault of the first copy."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    rows = rows.withColumns({"_a": F.xxhash64("role", "text"), "_b": F.xxhash64(F.lit(1), "role", "text")})
    rows = staged(rows, "conversation-rows")
    place = F.struct(F.col("turn").isNotNull().alias("timed"), F.col("turn").alias("turn"))
    again = rows.where("copies > 0").groupBy("conv_id", "_a", "_b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    again = again.where("n > 1").select(*[F.col(c).alias(f"{c}_of") for c in ("conv_id", "_a", "_b")], "first")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in ("conv_id", "_a", "_b")]
    rows = join_small(rows, again, same, "left")
    body = F.btrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(body == "", BLANK)
        .when(F.col("first").isNotNull() & (F.col("first") != place), DUPLICATE)
        .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), CUT)
        .otherwise(SOUND)
    )
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.cast("long").alias("fault"))


def repair(rows: DataFrame, texts: bool = True, slices: int | None = None) -> DataFrame:
    """One row a conversation: what was wrong, the cheapest repair's cost and audit, and its result.

    ``rows``: (conv_id, turn, role, text), and ``copies`` of each row where given (0: the row is
    gone, its conversation is not). Returns (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256, repaired); ``repaired`` holds the turns as ``role:text`` lines, or
    null without ``texts``.
    """
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text, copies.alias("copies"))
    rows = _judged(rows)
    order = ["conv_id", "turn", "role"]
    # rows of one turn and role may be many; a beginning of the text cuts them in the same order
    cut = rows.repartitionByRange(slices or slice_count(rows), *order, F.substring("text", 1, 64))
    cut = cut.sortWithinPartitions(*order, "text").withColumn("slice", F.spark_partition_id().cast("long"))
    runs = staged(cut.mapInArrow(_solve(texts), RUNS), "conversation-runs")
    whole = [x.split()[0] for x in WHOLE.split(", ")]

    key = {"conv": F.coalesce("conv_id", F.lit(0).cast("long")), "none": F.col("conv_id").isNull()}
    segments = runs.where("kind = 'segment'").withColumns(key)
    counts = [x.split()[0] for x in COUNTS.split(", ")]
    paths = staged(
        segments.select("conv", "none", "slice", *counts, *[x.split()[0] for x in SEGMENT.split(", ")])
        .groupBy("conv", "none").applyInArrow(_walk, PATHS),
        "conversation-paths",
    )
    own = runs.where("kind = 'row'").withColumns(key).select("conv", "none", "slice", *[x.split()[0] for x in ROW.split(", ")])
    slice_of = ["conv", "none", "slice"]
    written = own.groupBy(*slice_of).cogroup(paths.groupBy(*slice_of)).applyInArrow(_write, PIECES)
    in_order = staged(written, "conversation-pieces").repartition("conv", "none").sortWithinPartitions("conv", "none", "slice", "piece")
    return runs.where("kind = 'whole'").select(*whole).unionByName(in_order.mapInArrow(_finish(texts), WHOLE))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with damage that follows from (conv_id, turn); dropped rows have no copies."""
    name = [F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    gone = kind == 0
    return conversations.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, F.lit("")).when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(gone | (kind == 1), F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(gone, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def digest(conversations: DataFrame) -> DataFrame:
    return repair(damage(conversations), texts=False).drop("repaired")
