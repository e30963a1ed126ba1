"""Conversation structure repair: the cheapest edits that make the roles follow `(s?(ua)+)?`, by one integer minimum.

A conversation's rows are read in order. Each row is kept, given another role (user or assistant) or deleted, and empty
user or assistant turns may be put in. The states of the roles written so far are: nothing, after s, after u, after a.
An edge of the graph is one row's edit, with or without an inserted turn before it; its weight is ONE integer: the cost
stands in the high digits, and in the digits of the row's own slot stand the letters of the edits, first letter first,
zero digits behind (D < I < K < R as in ASCII). A slot's letters end with that of the row and are I before, so no slot is
the beginning of another and comparing two integers compares cost first and then the audits as texts; the last slot, an
I or nothing, is padded by zero, so the shorter audit comes first. The least integer at an accepted state so decides cost,
audit, roles and text at once. Two turns put in one after the other are never cheapest: without them the roles are right
as well, and a lone s is cheaper deleted.

Integers stay short: after BLOCK rows the digits of the at most four survivors are replaced by their rank, which keeps
every comparison, and the letters are linked to the survivor they came from.

Plan: rows are dealt by conversation and sorted within partitions, which spills; each partition is then read as a stream.
The digest of a repaired conversation goes over its texts in order, so one task must see a conversation; it holds no text
but that of the row at hand, the four survivors' digests, and four short integers for every BLOCK rows. Rows seen
earlier are found by a window over the same partitioning, without another shuffle.

Defined cases: null role, text, turn or id count as one space in keys and texts, and a null turn comes first; the id null
is a conversation of its own. Rows of one turn are ordered by role and text. A role's initial is its first character; one
that is not s, u or a, and the empty role, cannot be kept. Repeated rows are duplicates. A conversation without rows has zeros, an empty audit and the
digest of the empty text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import width

# The costs of the edits and what an unfinished row costs that stays.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
UNFINISHED = 5
MODULUS = 20
DROPPED, EMPTIED, UNSTOPPED, REPEATED, RENAMED = range(5)

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: State after writing an initial.
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(["su", "ua", "au"])
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)

BLOCK = 32
DIGIT = 3
SLOT = 2 * DIGIT
LETTERS = " DIKR"
CODE = {c: i for i, c in enumerate(LETTERS) if i}
DIGITS = SLOT * (BLOCK + 1)
RANK = 1 << DIGITS
#: The lowest digit of the cost; below it two bits of rank and the slots of a block and of the end.
UNIT = RANK << 2


def _edges(fault: int, initial: str) -> list[tuple[int, int, int, int, tuple[str, ...]]]:
    """The edges of one kind of row, by state: (from, to, cost, code of the slot, what is written)."""
    out = []
    stays = UNFINISHED if fault == TRUNCATED else 0
    for state in (START, AFTER_S, AFTER_U, AFTER_A):
        turns = [(state, "", 0, ())]
        turns += [(NEXT[state, x], "I", COST["I"], (x,)) for x in "ua" if (state, x) in NEXT]
        for now, before, paid, written in turns:
            ends = [(now, "D", COST["D"], ())]
            if fault not in (BLANK, DUPLICATE):
                if (now, initial) in NEXT:
                    ends.append((NEXT[now, initial], "K", COST["K"] + stays, ("K",)))
                ends += [(NEXT[now, x], "R", COST["R"] + stays, (ROLES[x],)) for x in "ua" if (now, x) in NEXT]
            for then, letter, cost, last in ends:
                letters = (before + letter).ljust(2)
                code = sum((CODE.get(c, 0)) << DIGIT * (1 - i) for i, c in enumerate(letters))
                out.append((state, then, paid + cost, code, (*[f"I{x}" for x in written], *last)))
    return out


EDGES = {(fault, initial): _edges(fault, initial) for fault in range(4) for initial in ("s", "u", "a", "")}


class Repair:
    """The running repair of one conversation."""

    def __init__(self) -> None:
        self.value: list[int | None] = [0, None, None, None]
        self.digest = [hashlib.sha256(), None, None, None]
        #: Of each block that is done: letters and rank of every survivor, and the survivor of each new rank.
        self.past: list[tuple[list[tuple[int, int] | None], dict[int, int]]] = []
        self.slot = 0

    def add(self, fault: int, role: str, text: str) -> None:
        if self.slot == BLOCK:
            self._turn()
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        shift = SLOT * (BLOCK - self.slot)
        best: list[tuple | None] = [None] * 4
        for state, then, cost, code, written in EDGES[fault, initial]:
            value = self.value[state]
            if value is not None:
                value += cost * UNIT + (code << shift)
                if best[then] is None or value < best[then][0]:
                    best[then] = (value, state, written)
        digest = []
        for found in best:
            if found is None:
                digest.append(None)
                continue
            _, state, written = found
            new = self.digest[state].copy()
            first = state == START
            for w in written:
                line = f"{ROLES[w[1]]}:" if w[0] == "I" else f"{role if w == 'K' else w}:{text}"
                new.update((line if first else "\n" + line).encode())
                first = False
            digest.append(new)
        self.value, self.digest = [b and b[0] for b in best], digest
        self.slot += 1

    def _turn(self) -> None:
        """Keep the letters of a block and put ranks in their place."""
        alive = sorted((v % UNIT, q) for q, v in enumerate(self.value) if v is not None)
        origin = {rank: q for rank, (_, q) in enumerate(alive)}
        self.past.append(([None if v is None else (v % RANK, v % UNIT // RANK) for v in self.value], origin))
        for rank, q in origin.items():
            self.value[q] = self.value[q] // UNIT * UNIT + rank * RANK
        self.slot = 0

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair."""
        ends = [(self.value[q], q, False) for q in (START, AFTER_A) if self.value[q] is not None]
        if self.value[AFTER_U] is not None:
            shift = SLOT * (BLOCK - self.slot)
            ends.append((self.value[AFTER_U] + COST["I"] * UNIT + ((CODE["I"] << DIGIT) << shift), AFTER_U, True))
        value, state, more = min(ends)
        digest = self.digest[state]
        if more:
            digest = digest.copy()
            digest.update(f"\n{ROLES['a']}:".encode())
        blocks, low, rank = [], value % RANK, value % UNIT // RANK
        for letters, origin in reversed(self.past):
            blocks.append(low)
            low, rank = letters[origin[rank]]
        blocks.append(low)
        audit = "".join("".join(LETTERS[b >> DIGIT * i & 7] for i in reversed(range(2 * BLOCK + 2))) for b in reversed(blocks))
        return value // UNIT, audit.replace(" ", ""), digest.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows with the faults that crc32 of `conv_id:turn` gives them. Dropped rows stay
    marked, without text, so that their conversation is known."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % MODULUS
    role = F.when(kind == RENAMED, "user").otherwise(shown("role"))
    text = F.when(kind.isin(DROPPED, EMPTIED), "").when(kind == UNSTOPPED, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == DROPPED).alias("dropped"), F.explode(F.when(kind == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, dropped) with their fault, dealt by conversation and in order within partitions."""
    sign = r"[^\x20\x09-\x0D]"
    again = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(~F.col("text").rlike(sign), BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(NO_FAULT)
    dealt = rows.repartition(width(rows.sparkSession), "conv_id").withColumn("seen", F.row_number().over(again))
    return dealt.withColumn("fault", fault).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "seen")


class _Report:
    """The columns of one conversation, row by row."""

    def __init__(self) -> None:
        self.repair, self.faults, self.illegal, self.last = Repair(), [0] * 4, 0, None
        self.turns, self.low, self.turn = 0, None, None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.repair.add(fault, role, text)
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.low = turn if self.low is None else self.low

    def row(self, conv_id) -> tuple:
        cost, audit, digest = self.repair.result()
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        return conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, audit, digest


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
#: Conversations of one batch that goes out.
OUT = 4096


def _repairs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    current, report, out = None, None, []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        for conv_id, turn, role, text, dropped, fault in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "fault")), strict=True):
            if report is None or conv_id != current:
                if report is not None:
                    out.append(report.row(current))
                    if len(out) == OUT:
                        yield made()
                        out = []
                current, report = conv_id, _Report()
            if not dropped:
                report.add(turn, role, text, fault)
    if report is not None:
        out.append(report.row(current))
        yield made()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text and perhaps dropped): COLUMNS."""
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    key = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", key), *(T.StructField(c, T.LongType()) for c in COLUMNS[:6]), *(T.StructField(c, T.StringType()) for c in COLUMNS[6:])])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return ordered(rows).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "dropped", "fault").mapInArrow(lambda batches: _repairs(batches, arrow), schema)


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, from their audits; place counts from 0."""
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "seen")
    source = ordered(rows).where(~F.col("dropped")).select("conv_id", F.row_number().over(order).alias("n"), "role", "text")
    edits = repairs.select("conv_id", F.posexplode(F.split("audit", "(?!^)(?=.)"))).where("col <> ''")
    so_far = Window.partitionBy("conv_id").orderBy("pos")
    edits = edits.select("conv_id", F.col("col").alias("edit"), F.sum((F.col("col") != "I").cast("int")).over(so_far).alias("n"), (F.sum((F.col("col") != "D").cast("int")).over(so_far) - 1).alias("place")).where("edit <> 'D'")
    joined = edits.join(source.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")) & (edits["n"] == source["n"]) & (F.col("edit") != "I"), "left")
    system = F.max((F.col("edit") == "K") & (F.col("place") == 0) & F.col("role").startswith("s")).over(Window.partitionBy("conv_id"))
    turn = F.when((F.col("place") + F.col("system").cast("int")) % 2 == 0, "user").otherwise("assistant")
    return joined.withColumn("system", F.coalesce(system, F.lit(False))).select("conv_id", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(turn).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
