import hashlib
import heapq
import random
import re
from itertools import product
from zlib import crc32

import pytest

from stayline.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, cost int, conv string, part string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def cheapest(rows):
    """Least (cost, audit) and its lines by a search over (row, state), whatever the target's length."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in (0, 3):
            return cost, audit, lines
        done.add((i, state))
        after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        role = "assistant" if state == 2 else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", i, after, (*lines, f"{role}:")))
        if i == len(rows):
            continue
        fault, own, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        if own[:1] == role[0]:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, after, (*lines, f"{own}:{text}")))
        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, after, (*lines, f"{role}:{text}")))
        if own[:1] == "s" and state == 0:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1, (*lines, f"{own}:{text}")))
    raise AssertionError


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        hurt = damage([r for r in rows if r[0] == conv])
        faulty, seen = [], set()
        for _, role, text in hurt:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((fault, role, text))
        turns = [t for t, _, _ in hurt if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(hurt, hurt[1:]))
        cost, audit, lines = cheapest(faulty)
        n = [sum(f == k for f, _, _ in faulty) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made_up(rng, n, turns):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, turns)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            text = rng.choice(["Yes.", "No!", "why?", "cut short", " ", None, "tail. \n", "", "über…", "　", "a?\x0b", "x" * 70 + rng.choice("ab.")])
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]) if rng.random() > 0.1 else None, role, text))
    return rows


def given(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA)


def result(frame):
    assert frame.columns == NAMES
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("piece", [128, 3])
def test_against_search(spark, piece):
    rng = random.Random(piece)
    rows = made_up(rng, 300, 9)
    rows += rows[:60]  # repeated rows
    rows += [(None, t, ["user", "assistant"][t % 2], "fine.") for t in range(6)] + [(None, None, None, None)]
    assert result(c.repair(given(spark, rows).repartition(3), piece)) == brute(rows)


def test_long_conversation_in_pieces(spark):
    rng = random.Random(5)
    rows = made_up(rng, 1, 1) + [(7, t, rng.choice(["user", "assistant"]), f"{rng.randint(0, 900)}{rng.choice(['.', '', '!'])}") for t in range(900)]
    assert result(c.repair(given(spark, rows).repartition(4))) == brute(rows)


def test_all_rows_dropped(spark):
    gone = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "hello."), (gone, 0, "user", "hello.")]
    assert result(c.repair(given(spark, rows))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert c.repair(given(spark, rows).limit(0)).count() == 0


def test_pieces_agree_with_whole():
    """A conversation as one piece, or as two at any place, has the edits of the whole."""
    import pandas as pd

    def joined(parts):
        rows = []
        for k, (initials, losses) in enumerate(parts):
            piece = c.Piece("=1", k, list(initials), list(losses), [0] * (len(initials) + 1))
            rows.append(piece.row(False))
        return tuple(c.put_together(pd.DataFrame(rows, columns=c.PIECE_NAMES))[["cost", "audit"]].iloc[0])

    for n in range(5):
        for initials in product("usa", repeat=n):
            for losses in {(0,) * n, (5,) * n, tuple(5 * (i % 2) for i in range(n))}:
                want = c.whole_cost(list(initials), list(losses))
                faulty = [("truncated" if loss else None, x, "") for x, loss in zip(initials, losses)]
                assert want == cheapest(faulty)[:2]
                for at in range(n + 1):
                    assert joined([(initials[:at], losses[:at]), (initials[at:], losses[at:])]) == want


def test_incumbent_is_reachable():
    rng = random.Random(1)
    for _ in range(2000):
        n = rng.randint(0, 12)
        initials, losses = [rng.choice("uasx") for _ in range(n)], [rng.choice([0, 0, 5]) for _ in range(n)]
        want = cheapest([("truncated" if loss else None, x, "") for x, loss in zip(initials, losses)])[:2]
        assert c.incumbent(initials, losses) >= want[0]
        assert c.whole_cost(initials, losses) == want


def test_given_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert result(c.repair(rows)) == brute([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
