"""Repair of conversations whose turns should alternate: alignment with the strings that the grammar allows.

A sound conversation is empty or has an optional system turn and then pairs of a user's and an assistant's turn. Turns
are kept, given another role, deleted or inserted, each at a cost; the cheapest edits win, of those the least audit
(the edits' initials in order).

Every target is an alternating string, so targets of all lengths are suffixes of one another and share one Wagner-Fischer
table, read from its end: its first row has the cost of each feasible length. The table is filled only in Ukkonen's band,
as wide as the cost of the incumbent (a repair without look-ahead) allows. The lengths of least cost are traced back and
their audits compared. A long conversation is aligned in blocks of BLOCK turns: for each state of the grammar
before a block and behind it the best audit of the block is kept, and what all states have in common is settled, so
no table grows with the square of a conversation.

In Spark, turns become symbols before anything is gathered: the alignment reads one letter a turn. Texts are shuffled
once, to be written in order behind their conversation's audit, as a stream that holds no conversation whole.
"""

from __future__ import annotations

from functools import lru_cache
from os.path import commonprefix

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import arrow_schema, if_small, lean, shuffle_partitions, written

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
BLOCK, REMEMBERED = 256, 64
#: States of the grammar: nothing yet; a system turn; a user's turn is next, or the end; an assistant's is next.
START, OPENED, USER, ASSISTANT = "^", "s", "u", "a"
_FAR = 1 << 60
ROLES = {"u": "user", "a": "assistant"}


def symbol(initial: str, gone: bool, cut: bool) -> str:
    """One letter for a turn: '-' if it has to go, else its role's initial, upper case if it is cut short ('x': no role of the grammar)."""
    letter = initial if initial and initial in "sua" else "x"
    return "-" if gone else letter.upper() if cut else letter


def _without_look_ahead(block: str, state: str) -> int:
    """What a repair costs that gives every turn it may keep the role that is due; two more insertions end in any state."""
    cost, due = 2 * INSERT, "a" if state == ASSISTANT else "u"
    for x in block:
        if x == "-":
            cost += DELETE
        else:
            cost += (KEEP if x.lower() == due else REROLE) + (CUT_SHORT if x.isupper() else 0)
            due = "a" if due == "u" else "u"
    return cost


def suffix_costs(block: str, last: str, bound: int) -> list[tuple[int, list[int]]]:
    """For each place of the block (first, costs): costs[k] is the least of aligning the turns from there on with the last
    first + k letters of the alternating string that ends in `last`, where that is at most the bound."""
    up, down, before = bound // INSERT, bound // DELETE, "u" if last == "a" else "a"
    table = [(0, [INSERT * r for r in range(up + 1)])]
    for m in range(1, len(block) + 1):
        x = block[len(block) - m]
        base, below = table[-1]
        own, cut = x.lower(), CUT_SHORT if x.isupper() else 0
        due = (cut + (KEEP if own == before else REROLE), cut + (KEEP if own == last else REROLE))
        first, row, left, n = max(0, m - down), [], _FAR, len(below)
        for r in range(first, m + up + 1):
            k = r - base
            best = below[k] + DELETE if 0 <= k < n else _FAR
            if x != "-" and 0 < k <= n and r:
                best = min(best, below[k - 1] + due[r & 1])
            best = left = min(best, left + INSERT)
            row.append(best)
        table.append((first, row))
    return table[::-1]


def _cost(table, at: int, r: int) -> int:
    first, row = table[at]
    return row[r - first] if 0 <= r - first < len(row) else _FAR


def _traced(table, block: str, last: str, at: int, r: int) -> str:
    """The least audit of the cheapest alignments of the turns from `at` on with the last r letters."""
    out, n, before = [], len(block), "u" if last == "a" else "a"
    while at < n or r:
        now = _cost(table, at, r)
        if at < n and _cost(table, at + 1, r) + DELETE == now:
            out.append("D")
            at += 1
        elif r and _cost(table, at, r - 1) + INSERT == now:
            out.append("I")
            r -= 1
        else:
            out.append("K" if block[at].lower() == (last if r & 1 else before) else "R")
            at, r = at + 1, r - 1
    return "".join(out)


def transfers(block: str, state: str, ends: str) -> dict[str, tuple[int, str]]:
    """The least (cost, audit) by which a block leads from a state to each of the states in ends that it can lead to."""
    out, n = {}, len(block)
    if state in (START, OPENED) and state in ends:
        out[state] = (DELETE * n, "D" * n)
    opening = [k for k, x in enumerate(block) if x in "sS"] if state == START else []
    if OPENED in ends and opening:
        out[OPENED] = min((DELETE * (n - 1) + (CUT_SHORT if block[k] == "S" else 0), "D" * k + "K" + "D" * (n - 1 - k)) for k in opening)
    bound = _without_look_ahead(block, state)
    for end, last in ((USER, "a"), (ASSISTANT, "u")):
        if end not in ends:
            continue
        table = suffix_costs(block, last, bound)
        odd = (end == USER) == (state == ASSISTANT)
        least = 1 if odd else 0 if state in (USER, ASSISTANT) else 2
        begun = [(0, 0, "")] + [(k + 1, DELETE * k + (CUT_SHORT if block[k] == "S" else 0), "D" * k + "K") for k in opening if DELETE * k <= bound]
        found = [(spent + c, at, r, audit) for at, spent, audit in begun for first, row in [table[at]] for r, c in enumerate(row, first) if r >= least and r % 2 == odd]
        cheapest = min(x[0] for x in found)
        if cheapest < _FAR:
            out[end] = (cheapest, min(audit + _traced(table, block, last, at, r) for cost, at, r, audit in found if cost == cheapest))
    return out


class Repair:
    """Takes a conversation's symbols one by one and holds a block of them, and what is not settled of the audits."""

    def __init__(self):
        self.ways, self.settled, self.block = {START: (0, "")}, [], []

    def add(self, letter: str) -> None:
        self.block.append(letter)
        if len(self.block) == BLOCK:
            self._advance(START + OPENED + USER + ASSISTANT)

    def _advance(self, ends: str) -> None:
        ways: dict[str, tuple[int, str]] = {}
        block, self.block = "".join(self.block), []
        for state, (spent, audit) in self.ways.items():
            for end, (cost, more) in transfers(block, state, ends).items():
                ways[end] = min(ways.get(end, (_FAR, "")), (spent + cost, audit + more))
        common = commonprefix([audit for _, audit in ways.values()])
        self.settled.append(common)
        self.ways = {state: (cost, audit[len(common) :]) for state, (cost, audit) in ways.items()}

    def end(self) -> tuple[int, str]:
        self._advance(START + USER)
        cost, audit = min(self.ways.values())
        return cost, "".join(self.settled) + audit


@lru_cache(REMEMBERED << 10)
def _short(symbols: str) -> tuple[int, str]:
    repair = Repair()
    for x in symbols:
        repair.add(x)
    return repair.end()


def cheapest_repair(symbols: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation's symbols (see symbol())."""
    return _short(symbols) if len(symbols) <= REMEMBERED else _short.__wrapped__(symbols)


def faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it ends in anything but a full stop, exclamation or question mark."""
    ended = F.rtrim(text, F.lit(BLANKS))
    return ended == "", ~F.substring(ended, -1, 1).isin(".", "!", "?")


def _turn_key(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Reader:
    """One conversation's turns in order: faults are counted, symbols handed on to the repair."""

    def __init__(self):
        self.turns = self.low = self.high = self.before = self.repeat = None
        self.distinct = self.served = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.repair = Repair()
        self.symbols: list[str] | None = []

    def turn(self, turn, key, initial, blank, cut):
        again = False
        if self.repeat and self.repeat[:2] == (turn, key):
            again = self.served > 0 or not self.repeat[2]
            self.served += 1
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not (blank or again)
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        letter = symbol(initial, blank or again, cut)
        if self.symbols is not None and len(self.symbols) < REMEMBERED:
            self.symbols.append(letter)
            return
        for x in self.symbols or ():
            self.repair.add(x)
        self.symbols = None
        self.repair.add(letter)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        cost, audit = self.repair.end() if self.symbols is None else cheapest_repair("".join(self.symbols))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _turns(table: DataFrame) -> DataFrame:
    """conv_id, turn, role and text; a null role or text is one space."""
    blank = F.lit(" ")
    return table.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))


def audits(table: DataFrame, of: DataFrame | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation of table (conv_id, turn, role, text).

    With `of` (conv_id), conversations that have no turn in table come too, with zeros and an empty audit. Turns stand by
    number, null first, and those of one number by an MD5 of role and text. A null conv_id is a conversation like
    others; a null role or text is one space. gaps: numbers between the least and the greatest that no turn has. Of a
    turn's faults the first counts: blank, duplicate (role and text as in an earlier turn), truncated (no full stop,
    exclamation or question mark at the end).
    """
    rows = _turns(table)
    blank, cut = faults(F.col("text"))
    slim = rows.select("conv_id", F.lit(1).alias("stage"), "turn", _turn_key(F.col("role"), F.col("text")).alias("key"), F.lit(1).alias("kind"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"), F.lit(False).alias("first"))
    number = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    twice = written(slim.groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.min(number).alias("at")).filter("n > 1").select(F.col("conv_id").alias("conv__"), F.col("key").alias("key__"), F.col("at.turn").alias("at__")))
    same = slim["conv_id"].eqNullSafe(F.col("conv__")) & (slim["key"] == F.col("key__"))
    marked = slim.join(if_small(twice, broadcast_rows), same).groupBy("conv_id", "turn", "key").agg(F.min(F.col("turn").eqNullSafe(F.col("at__"))).alias("first"))
    none, no = F.lit(None), F.lit(False)
    marks = marked.select("conv_id", F.lit(1).alias("stage"), "turn", "key", F.lit(0).alias("kind"), none.cast("string").alias("initial"), no.alias("blank"), no.alias("cut"), "first")
    named = (of if of is not None else table).select("conv_id").distinct()
    heads = named.select("conv_id", F.lit(0).alias("stage"), none.cast("long").alias("turn"), none.cast("binary").alias("key"), F.lit(0).alias("kind"), none.cast("string").alias("initial"), no.alias("blank"), no.alias("cut"), no.alias("first"))
    schema = T.StructType([T.StructField("conv_id", table.schema["conv_id"].dataType), *(T.StructField(n, T.LongType()) for n in _COUNTS), T.StructField("audit", T.StringType())])
    to = arrow_schema(schema)

    @lean
    def read(batches):
        reader, conv = None, None
        for b in batches:
            out = []
            for this, stage, turn, key, kind, initial, blank, cut, first in zip(*(b.column(k).to_pylist() for k in range(9)), strict=True):
                if reader is None or this != conv:
                    if reader:
                        out.append((conv, *reader.result()))
                    reader, conv = _Reader(), this
                if stage and kind:
                    reader.turn(turn, key, initial, blank, cut)
                elif stage:
                    reader.repeat, reader.served = (turn, key, first), 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(to)], schema=to)
        if reader:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((conv, *reader.result()), to, strict=True)], schema=to)

    order = ["conv_id", "stage", "turn", "key", "kind"]
    dealt = heads.union(marks).union(slim).repartition(shuffle_partitions(table.sparkSession), "conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(read, schema)


def repaired_turns(table: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns that are left or new in each conversation, by the audits of `plans`.

    A conversation's turns come in order and side by side. Inserted turns have an empty text.
    """
    rows = _turns(table)
    blank = F.lit(None)
    body = rows.select("conv_id", F.lit(1).alias("stage"), "turn", _turn_key(F.col("role"), F.col("text")).alias("key"), "role", "text")
    heads = plans.select("conv_id", F.lit(0).alias("stage"), blank.cast("long").alias("turn"), blank.cast("binary").alias("key"), blank.cast("string").alias("role"), F.col("audit").alias("text"))
    schema = T.StructType([T.StructField("conv_id", table.schema["conv_id"].dataType), T.StructField("place", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("role", "text", "edit"))])
    to = arrow_schema(schema)

    @lean
    def write(batches):
        conv, audit, at, place, pairs_from = None, "", 0, 0, 0

        def put(out, edit, role, text):
            nonlocal place, pairs_from
            if edit == "K" and place == 0 and role[:1] == "s":
                pairs_from = 1
            due = ROLES["u" if (place - pairs_from) % 2 == 0 else "a"]
            out.append((conv, place, role if edit == "K" else due, "" if edit == "I" else text, edit))
            place += 1

        def rest(out):
            nonlocal at
            while at < len(audit):
                put(out, audit[at], None, None)  # only insertions are left
                at += 1

        for b in batches:
            out = []
            for this, stage, role, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 4, 5)), strict=True):
                if not stage:
                    rest(out)
                    conv, audit, at, place, pairs_from = this, text, 0, 0, 0
                    continue
                while audit[at] == "I":
                    put(out, "I", None, None)
                    at += 1
                if audit[at] != "D":
                    put(out, audit[at], role, text)
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(to)], schema=to)
        out = []
        rest(out)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(to)], schema=to)

    dealt = heads.union(body).repartition(shuffle_partitions(table.sparkSession), "conv_id").sortWithinPartitions("conv_id", "stage", "turn", "key")
    return dealt.select("conv_id", "stage", "turn", "key", "role", "text").mapInArrow(write, schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired_turns(): hash of role:text of each turn, joined by line ends. Texts pass one by one."""
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])
    to = arrow_schema(schema)

    @lean
    def run(batches):
        conv, state = None, None
        for b in batches:
            out = []
            for this, place, role, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if place == 0:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = this, hashlib.sha256()
                state.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(to)], schema=to)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], to.field(0).type), pa.array([state.hexdigest()])], schema=to)

    return turns.select("conv_id", "place", "role", "text").mapInArrow(run, schema)


def damaged(table: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of conv_id:turn (null: one space): in 20, one row each is dropped, emptied, robbed of .!?,
    repeated, or made the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = _turns(table).withColumn("hit", hit).filter("hit != 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired(table: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """audits() with repaired_sha256, the hash of each repaired conversation."""
    plans = written(audits(table, of))
    hashes = digests(repaired_turns(table, plans)).withColumnRenamed("conv_id", "conv__")
    joined = plans.join(hashes, plans["conv_id"].eqNullSafe(F.col("conv__")), "left").drop("conv__")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
