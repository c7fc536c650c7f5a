"""Repair of conversations: turns are aligned to the alternating grammar by Wagner-Fischer tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.session import freeze, stored

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
PIECE = 128  # turns that one table aligns; a longer conversation is put together from pieces
FAR = 1 << 40
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
WHOLE, BLANK, DUPLICATE, CUT_SHORT, GONE = range(5)
# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. What ends a conversation in each.
CLOSING = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as the checksum of `conv_id:turn` damages them; of dropped rows only the conversation stays, with no copies."""
    text = F.coalesce("text", F.lit(" "))
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    turn = F.col("turn").cast("long")
    told = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        kind.alias("kind"),
        F.when(kind == 0, 2).when(turn.isNull(), 0).otherwise(1).alias("has"),
        F.when((kind == 0) | turn.isNull(), 0).otherwise(turn).alias("at"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    ).drop("kind")
    return told.withColumns({"head": F.substring("text", 1, 64), "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256))})


ORDER = ["conv", "has", "at", "role", "head", "digest"]


def thin_rows(rows: DataFrame) -> DataFrame:
    """One row without text for all equal rows of a conversation: initial, copies and first fault of the first of them."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(F.col("has") == 2, GONE).when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), WHOLE).otherwise(CUT_SHORT)
    thin = rows.withColumn("fault", fault).groupBy(*ORDER, "fault").agg(F.sum("copies").alias("copies"))
    turn = F.struct("has", "at")
    again = thin.where(F.col("fault").isin(WHOLE, CUT_SHORT)).groupBy("conv", "role", "digest").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    thin = thin.join(again, ["conv", "role", "digest"], "left")
    seen = F.col("fault").isin(WHOLE, CUT_SHORT) & (turn > F.col("first"))
    return thin.select(*ORDER, F.left("role", F.lit(1)).alias("initial"), F.when(seen, DUPLICATE).otherwise(F.col("fault")).alias("fault"), "copies")


class Table:
    """Costs of aligning the last turns to the last characters of an alternating target that ends in `last`.

    Targets of all lengths share one table, as each is the end of the next
    longer one. Cells beyond what the incumbent cost pays for in deletions or
    insertions are left out (Ukkonen's band). `closed` tables may end in
    insertions; others leave those to what follows.
    """

    def __init__(self, initials: list[str], losses: list[int], last: str, bound: int, closed: bool):
        n = len(initials)
        self.initials, self.n, self.last = initials, n, last
        self.width = n + bound // INSERT + 1
        self.cells = np.full((n + 1, self.width), FAR, dtype=np.int64)
        places = np.arange(self.width, dtype=np.int64)
        paid = places * INSERT
        end = min(bound // INSERT + 1, self.width) if closed else 1
        self.cells[n, :end] = paid[:end]
        odd = (places % 2).astype(bool)
        other = "u" if last == "a" else "a"
        for i in range(n - 1, -1, -1):
            low, high = max(0, n - i - bound // DELETE), min(self.width, n - i + bound // INSERT + 1)
            below = self.cells[i + 1]
            row = below[low:high] + DELETE
            match = losses[i] + np.where(odd[low:high], REROLE * (initials[i] != last), REROLE * (initials[i] != other))
            if low:
                row = np.minimum(row, below[low - 1 : high - 1] + match)
            else:
                row[1:] = np.minimum(row[1:], below[: high - 1] + match[1:])
            self.cells[i, low:high] = np.minimum.accumulate(row - paid[low:high]) + paid[low:high]

    def char(self, place: int) -> str:
        return self.last if place % 2 else "ua"[self.last == "u"]

    def trace(self, i: int, j: int) -> str:
        """The least string of edits among the cheapest from one cell on."""
        out, cells = [], self.cells
        while i < self.n or j > 0:
            cost = cells[i, j]
            if i < self.n and cells[i + 1, j] + DELETE == cost:
                out.append("D")
                i += 1
            elif j > 0 and cells[i, j - 1] + INSERT == cost:
                out.append("I")
                j -= 1
            else:
                out.append("K" if self.initials[i] == self.char(j) else "R")
                i, j = i + 1, j - 1
        return "".join(out)

    def best(self, lengths: np.ndarray, losses: list[int], after_system: bool) -> tuple[int, list[str]]:
        """Least cost over target lengths, and the edits of each length that has it.

        With `after_system` a kept system turn comes first and all turns before it go.
        """
        lengths = lengths[lengths < self.width]
        least, found = FAR, []
        starts = [i for i, c in enumerate(self.initials) if c == "s"] if after_system else [None]
        for i in starts:
            costs = self.cells[0, lengths] if i is None else self.cells[i + 1, lengths] + DELETE * i + losses[i]
            if not len(costs) or costs.min() > least or costs.min() >= FAR:
                continue
            if costs.min() < least:
                least, found = int(costs.min()), []
            before = "" if i is None else "D" * i + "K"
            found += [before + self.trace(0 if i is None else i + 1, int(m)) for m in lengths[costs == least]]
        return least, found


def incumbent(initials: list[str], losses: list[int]) -> int:
    """Cost of a plain way through: take turns as they come, drop those cut short and a last one without answer."""
    cost, out, last = 0, 0, 0
    for i, (c, loss) in enumerate(zip(initials, losses, strict=True)):
        if loss or (c == "s" and i):
            cost += DELETE
            continue
        if c == "s":
            continue
        last = REROLE * (c != "ua"[out % 2])
        cost += last
        out += 1
    kept_system = bool(initials) and initials[0] == "s" and not losses[0]
    cost += out % 2 * (DELETE - last) + DELETE * (kept_system and out < 2)
    return min(cost, DELETE * len(initials))


def whole_cost(initials: list[str], losses: list[int]) -> tuple[int, str]:
    """Cheapest edits of a whole conversation, over every feasible length of the target."""
    n, bound = len(initials), incumbent(initials, losses)
    table = Table(initials, losses, "a", bound, True)
    even = np.arange(2, table.width, 2)
    options = [(DELETE * n, ["D" * n]), table.best(even, losses, False), table.best(even, losses, True)]
    cost = min(c for c, _ in options)
    return cost, min(a for c, audits in options if c == cost for a in audits)


def piece_costs(initials: list[str], losses: list[int]) -> tuple[list[int], list[str]]:
    """Cheapest edits of part of a conversation for each state before and after it (4 x 4; FAR where there is no way)."""
    n = len(initials)
    bound = DELETE * n + 2 * INSERT
    tables = {2: Table(initials, losses, "u", bound, False), 3: Table(initials, losses, "a", bound, False)}
    costs, audits = [], []
    for before in range(4):
        for after in range(4):
            options = [(DELETE * n, ["D" * n])] if before == after else []
            if (before, after) == (0, 1):
                options = [(DELETE * (n - 1) + losses[i], ["D" * i + "K" + "D" * (n - 1 - i)]) for i, c in enumerate(initials) if c == "s"]
            elif after >= 2:
                # An odd target that ends in u starts with u, an even one with a; the other way round for a.
                odd = (after == 2) != (before == 2)
                lengths = np.arange(1 if odd else 2, tables[after].width, 2)
                options.append(tables[after].best(lengths, losses, False))
                if before == 0:
                    options.append(tables[after].best(lengths, losses, True))
            cost = min((c for c, _ in options), default=FAR)
            costs.append(cost)
            audits.append(min((a for c, found in options if c == cost for a in found), default="") if cost < FAR else "")
    return costs, audits


def spread(audit: str, forced: list[int]) -> str:
    """Edits with the deletions of blank and repeated rows put in after the row they follow."""
    out, row = ["D" * forced[0]], 0
    for letter in audit:
        out.append(letter)
        if letter != "I":
            row += 1
            out.append("D" * forced[row])
    return "".join(out)


@dataclass
class Piece:
    """What is known of consecutive rows of one conversation."""

    conv: str
    place: int
    initials: list = field(default_factory=list)
    losses: list = field(default_factory=list)
    forced: list = field(default_factory=lambda: [0])
    counts: list = field(default_factory=lambda: [0, 0, 0])  # blank, duplicate, truncated
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    def add(self, has: int, at: int, initial: str, fault: int, copies: int):
        if fault == GONE:
            return
        self.illegal += copies - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.first = initial if self.first is None else self.first
        self.last = initial
        if has and at != self.high:
            self.turns += 1
            self.low = at if self.low is None else self.low
            self.high = at
        if fault in (BLANK, DUPLICATE):
            self.counts[fault == DUPLICATE] += copies
            self.forced[-1] += copies
            return
        self.counts[1] += copies - 1
        self.counts[2] += fault == CUT_SHORT
        self.initials.append(initial)
        self.losses.append(TRUNCATED * (fault == CUT_SHORT))
        self.forced.append(copies - 1)

    def row(self, whole: bool) -> tuple:
        if whole:
            cost, audit = whole_cost(self.initials, self.losses)
            costs, audits = [cost + DELETE * sum(self.forced)], [spread(audit, self.forced)]
        else:
            costs, audits = piece_costs(self.initials, self.losses)
            costs = [c + DELETE * sum(self.forced) if c < FAR else FAR for c in costs]
            audits = [spread(a, self.forced) if c < FAR else "" for a, c in zip(audits, costs, strict=True)]
        text = [None if x is None else str(x) for x in (self.low, self.high)]
        return (self.conv, whole, self.place, *self.counts, self.illegal, self.turns, *text, self.first, self.last, costs, audits)


# Turns travel as text, since pandas turns whole numbers beside nulls into floats.
PIECES = "conv string, whole boolean, place long, blank long, duplicate long, truncated long, illegal long, turns long, low string, high string, first string, last string, costs array<long>, audits array<string>"
PIECE_NAMES = [c.split(" ")[0] for c in PIECES.split(", ")]
AUDITS = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
AUDIT_NAMES = [c.split(" ")[0] for c in AUDITS.split(", ")]


def pieces(batches: Iterator[pd.DataFrame], size: int = PIECE) -> Iterator[pd.DataFrame]:
    """Conversations of one sorted slice, in pieces of at most `size` turns that can stay.

    A conversation is whole when it fits into one piece and touches neither end of the slice.
    """
    current, first, cut, out = None, True, False, []
    for batch in batches:
        for conv, place, has, at, initial, fault, copies in zip(*(batch[c].tolist() for c in ("conv", "_at", "has", "at", "initial", "fault", "copies")), strict=True):
            if current is None or conv != current.conv:
                if current is not None:
                    out.append(current.row(not first and not cut))
                    first = False
                current, cut = Piece(conv, place), False
            elif len(current.initials) == size and fault in (WHOLE, CUT_SHORT):
                out.append(current.row(False))
                current, cut = Piece(conv, place), True
            current.add(has, at, initial, fault, copies)
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=PIECE_NAMES)
                out = []
    if current is not None:
        out.append(current.row(False))
    if out:
        yield pd.DataFrame(out, columns=PIECE_NAMES)


def put_together(group: pd.DataFrame) -> pd.DataFrame:
    """One conversation from its pieces: cheapest states from the end, then the least edits from the start."""
    group = group.sort_values("place")
    costs = [np.array(c, dtype=np.int64).reshape(4, 4) for c in group["costs"]]
    ahead = [np.array([CLOSING[s][0] for s in range(4)], dtype=np.int64)]
    for c in reversed(costs):
        ahead.append((c + ahead[-1][None, :]).min(axis=1))
    ahead.reverse()
    state, audit = 0, []
    for k, (c, audits) in enumerate(zip(costs, group["audits"], strict=True)):
        ways = [(audits[4 * state + to], to) for to in range(4) if c[state, to] + ahead[k + 1][to] == ahead[k][state]]
        letters, state = min(ways)
        audit.append(letters)
    audit.append(CLOSING[state][1])
    illegal, turns, low, high, last = int(group["illegal"].sum()), 0, None, None, None
    for row in group.itertuples():
        if row.first is not None and last is not None:
            illegal += last + row.first not in LEGAL
        last = row.last if row.last is not None else last
        if row.low is not None:
            turns += row.turns - (high == int(row.low))
            low = int(row.low) if low is None else low
            high = int(row.high)
    gaps = 0 if low is None else high - low + 1 - turns
    counts = [int(group[c].sum()) for c in ("blank", "duplicate", "truncated")]
    return pd.DataFrame([(group["conv"].iloc[0], gaps, *counts, illegal, int(ahead[0][0]), "".join(audit))], columns=AUDIT_NAMES)


def audits(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Counts, cost and edits of every conversation of damaged rows.

    Rows without their texts are range-sorted, so a conversation of any length
    spreads over tasks; its pieces, a few bytes a turn, meet again at the end.
    """
    ordered = thin_rows(rows).orderBy(*ORDER).select("conv", "has", "at", "initial", "fault", "copies", F.monotonically_increasing_id().alias("_at"))
    found = stored(freeze(ordered).mapInPandas(lambda batches: pieces(batches, piece), PIECES), "pieces")
    low, high = F.col("low").cast("long"), F.col("high").cast("long")
    whole = found.where("whole").select(
        "conv", F.coalesce(high - low + 1 - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit")
    )
    return whole.unionByName(found.where("not whole").groupBy("conv").applyInPandas(put_together, AUDITS))


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per conversation its audit row with the digest of the repaired turns; the audit comes first, then the rows in order."""
    names = [*AUDIT_NAMES, "repaired_sha256"]
    told = digest = letters = None
    place = out = 0

    def write(line: str):
        nonlocal out
        digest.update(("\n" * bool(out) + line).encode("utf-8", "replace"))
        out += 1

    def expected(system: bool) -> str:
        return "ua"[(out - system) % 2]

    def inserted():
        nonlocal place
        while place < len(letters) and letters[place] == "I":
            write(ROLES[expected(system)] + ":")
            place += 1

    def done():
        inserted()
        return (*told, digest.hexdigest())

    system = False
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            if row.part == 0:
                if told is not None:
                    rows.append(done())
                told = [getattr(row, n) for n in AUDIT_NAMES[:-1]] + [row.text]
                digest, letters, place, out, system = hashlib.sha256(), row.text, 0, 0, False
                continue
            for _ in range(row.copies):
                inserted()
                letter = letters[place]
                place += 1
                if letter == "K":
                    system = system or (out == 0 and row.role[:1] == "s")
                    write(f"{row.role}:{row.text}")
                elif letter == "R":
                    write(f"{ROLES[expected(system)]}:{row.text}")
        if rows:
            yield pd.DataFrame(rows, columns=names)
    if told is not None:
        yield pd.DataFrame([done()], columns=names)


def repair(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Damage conversations by checksum, audit the cheapest repair of each and digest the repaired turns.

    Every turn costs what its edit costs: keep 0, new role 1, delete 2, insert
    5; a turn cut short that stays costs 5 more. Blank and repeated turns go.
    The rest is aligned to every feasible length of the alternating target;
    of equally cheap edits the least string is taken. Turns go by number
    (nulls first), equal numbers by role, then by the first 64 characters of
    the text, then by its digest.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, one row per conv_id of the table, a null one included.
    Null cells count as one blank. Repeated rows are repeated turns. Other
    columns are not looked at; an empty table gives none. One task writes a
    conversation's digest, row by row, and holds its edits, a letter a turn.
    """
    hurt = damaged(rows)
    found = audits(hurt, piece)
    counts = AUDIT_NAMES[1:-1]
    lines = hurt.where("copies > 0").select(*ORDER, "text", "copies", F.lit(1).alias("part"), *[F.lit(0).cast("long").alias(n) for n in counts])
    heads = found.select(
        "conv", F.lit(0).alias("has"), F.lit(0).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("head"), F.lit("").cast("binary").alias("digest"),
        F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(0).alias("part"), *counts,
    )
    together = heads.unionByName(lines).repartition("conv").sortWithinPartitions("conv", "part", *ORDER[1:])
    out = together.drop("has", "at", "head", "digest").mapInPandas(digests, AUDITS + ", repaired_sha256 string")
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(rows.schema["conv_id"].dataType).alias("conv_id")
    return out.select(conv_id, *counts, "audit", "repaired_sha256")
