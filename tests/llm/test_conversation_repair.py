import hashlib
import itertools
import random
import zlib

import pytest

from rillet.llm import conversation_repair as c

SCHEMA = "conv_id long, turn long, role string, text string, cost int, slice string, fault string"


def all_repairs(rows, most=3):
    """Every edit sequence with at most ``most`` insertions: (cost, audit)."""

    places = range(len(rows) + 1)
    choices = [itertools.combinations_with_replacement(places, n) for n in range(most + 1)]
    results = []
    for used in itertools.chain.from_iterable(choices):
        marked = []
        for i in range(len(rows) + 1):
            marked += [("+", None)] * used.count(i)
            if i < len(rows):
                marked.append(rows[i])

        def run(i, state, cost, audit, marked=marked):
            if i == len(marked):
                if state in (0, 3):
                    results.append((cost, audit))
                return
            initial, fault = marked[i]
            due, to = ("a", 3) if state == 2 else ("u", 2)
            if initial == "+":
                run(i + 1, to, cost + 5, audit + "I")
                return
            run(i + 1, state, cost + 2, audit + "D")
            if fault not in (c.BLANK, c.DUPLICATE):
                more = 5 if fault == c.CUT else 0
                run(i + 1, to, cost + 1 + more, audit + "R")
                if initial == due:
                    run(i + 1, to, cost + more, audit + "K")
                elif initial == "s" and state == 0:
                    run(i + 1, 1, cost + more, audit + "K")

        run(0, 0, 0, "")
    return results


def test_agenda_equals_all_edit_sequences():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice("suuaaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 6))]
        assert c.best(rows) == min(all_repairs(rows)), rows


def table(rows):
    """Forward table over (state): the lightest (cost, audit) after each row."""
    at = {0: (0, "")}

    def inserted(at):
        for _ in range(3):
            for q, (k, a) in list(at.items()):
                to = 3 if q == 2 else 2
                at[to] = min(at.get(to, (10**9, "")), (k + 5, a + "I"))
        return at

    for initial, fault in rows:
        now = {}
        for q, (k, a) in inserted(at).items():
            steps = [("D", 2, q)]
            if fault in (c.SOUND, c.CUT):
                more = 5 if fault == c.CUT else 0
                steps.append(("R", 1 + more, 3 if q == 2 else 2))
                after = {"s0": 1, "u0": 2, "u1": 2, "u3": 2, "a2": 3}.get(f"{initial}{q}")
                steps += [("K", more, after)] if after is not None else []
            for letter, cost, to in steps:
                now[to] = min(now.get(to, (10**9, "")), (k + cost, a + letter))
        at = now
    at = inserted(at)
    return min(at[q] for q in (0, 3) if q in at)


@pytest.mark.parametrize("block", [1, 2, 5, 32])
def test_blocks_joined_equal_one_table(monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK", block)
    rng = random.Random(block)
    for roles in ("suuaaax", "x", "ua", "uuuuua"):
        for _ in range(40):
            rows = [(rng.choice(roles), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 60))]
            assert c.best(rows) == table(rows), rows


def brute(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        own = convs.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text
        text = "".join(x for x in text if x not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, counts = set(), [], [0, 0, 0, 0]
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = c.BLANK if not body else c.DUPLICATE if (role, text) in seen else c.CUT if body[-1] not in ".!?" else c.SOUND
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role[:1], fault))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit = table(judged)
        kept, rest, state = [], iter(own), 0
        for letter in audit:
            due, to = ("assistant", 3) if state == 2 else ("user", 2)
            if letter == "I":
                kept.append(f"{due}:")
                state = to
                continue
            _, role, text = next(rest)
            if letter == "K":
                kept.append(f"{role}:{text}")
                state = 1 if role[:1] == "s" else to
            elif letter == "R":
                kept.append(f"{due}:{text}")
                state = to
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((conv, gaps, *counts[1:], illegal, cost, audit, sha))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def row(conv, turn, role="user", text="Fine."):
    return (conv, turn, role, text, 9, "x", "y")


def corpus():
    rng = random.Random(11)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            role = "system" if turn == 0 and rng.random() < 0.3 else ("user", "assistant")[(turn + rng.randrange(8) // 7) % 2]
            rows.append(row(conv, turn * rng.choice([1, 1, 1, 2]), role, rng.choice(["Yes.", "No", f"text {rng.random()}!", "é?\n ", " \t"])))
    # one conversation with most of the rows, also of one turn, and repeated rows
    rows += [row(100, i, ("user", "assistant", "tool")[i * i % 3], f"t{i % 50}.") for i in range(300)]
    rows += [row(101, None, "user", f"t{i}.") for i in range(80)] + [row(102, 1, "user", "same.")] * 50
    rows += [row(None, 1), row(None, None, None, None), row(103, 5, "", ""), row(104, 3, "umpire", "word " * 100_000)]
    rows += [row(105, t, "user") for t in range(400) if zlib.crc32(f"105:{t}".encode()) % 20 == 0][:3]  # all dropped
    rows += [row(-106, -3, "assistant"), row(-106, -3, "assistant"), row(-106, 2, "user"), row(-106, -3, "assistant", "other")]
    return rows


@pytest.mark.parametrize("slices", [1, 40])
def test_equals_brute_force(spark, monkeypatch, slices):
    """Many slices: conversations are cut, and their texts travel in pieces."""
    monkeypatch.setattr(c, "PIECE", 100 if slices > 1 else c.PIECE)
    monkeypatch.setattr(c, "BLOCK", 8)
    rows = corpus()
    random.Random(1).shuffle(rows)
    out = c.repair(c.damage(spark.createDataFrame(rows, SCHEMA)), slices=slices).toPandas()
    got = [tuple(None if x != x else int(x) if isinstance(x, float) else x for x in r) for r in out[COLUMNS].itertuples(index=False)]
    assert sorted(got, key=str) == brute(rows)
    assert all(hashlib.sha256(t.encode()).hexdigest() == h for t, h in zip(out.repaired, out.repaired_sha256, strict=True))


def test_empty_table(spark):
    assert c.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert c.digest(spark.createDataFrame([], SCHEMA)).columns == COLUMNS
