"""Repair of conversations: the cheapest edits that give them a legal sequence of roles, by weighted CYK parsing.

Legal is ``(s?(ua)+)?`` in role initials. An automaton of four states reads it; the repair grammar in Chomsky
normal form has a nonterminal for every pair of states: (p, r) -> (p, q) (q, r) for adjacent spans, and (p, q) ->
a row, kept, reroled or deleted. Insertions are closed into each row's cell, on both sides. A cell of the chart
holds the least (cost, audit) of its nonterminal; cells are combined bottom-up by span length, from rows over spans
of two, four, ... to the conversation. As nonterminals say where the automaton enters and leaves, every split of a
span gives the same cell, so that one split a span is enough; equally cheap audits of a cell are never prefixes of one
another (they would differ in insertions, which cost), so that the ASCII-least one stays least whatever follows.

On the cluster: rows are counted without their texts (a SHA-256 stands for each), equal ones together; later
repetitions are found by an aggregate of first turns; rows are dealt by ranges of (conversation, turn), so that a
long conversation is parsed in several tasks, whose spans are combined last. Texts are shuffled once, to be written in
repaired order. A conversation's SHA-256 is one pass over it, so one task streams it, a batch at a time.

Defined results
---------------
* null roles and texts are one space; a null conversation id is a conversation, null turns come first;
* rows of one turn are ordered by role, then by the text's SHA-256; repeated rows are repetitions;
* rows without any character but white space, and repetitions of role and text, have to be deleted;
* an empty table gives an empty result; other columns are not read;
* memory: a conversation's audit (a letter a row) is held for up to twelve pairs of states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, table

# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The automaton of legal sequences: 0 nothing yet, 1 after the system, 2 after the user, 3 after the assistant.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL_END = (0, 3)
LEGAL_PAIRS = {"su", "ua", "au"}
SPACES = " \t\n\v\f\r"
#: Conversations (as sequences of kinds of rows) whose cells a task keeps.
MEMO = 100_000

#: Kinds of faults.
SOUND, CUT, GONE = 0, 1, 2

#: The least (cost, audit) of each pair of states.
Cell = dict[tuple[int, int], tuple[int, str]]


# ------------------------------------------------------------------- the grammar


def combine(left: Cell, right: Cell) -> Cell:
    """(p, r) -> (p, q) (q, r): the cell of two adjacent spans."""
    out: Cell = {}
    for (p, q), (cost, audit) in left.items():
        for (s, r), (more, rest) in right.items():
            if q == s:
                total = cost + more
                have = out.get((p, r))
                if have is None or total < have[0] or (total == have[0] and audit + rest < have[1]):
                    out[p, r] = (total, audit + rest)
    return out


def _insertions() -> Cell:
    """What insertions alone derive: nothing, or steps of the automaton at a price."""
    out: Cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(3):
        for (p, q), (cost, audit) in list(out.items()):
            for role in "ua":
                r = STEP.get((q, role))
                if r is not None:
                    out[p, r] = min(out.get((p, r), (1 << 30, "")), (cost + INSERT, audit + "I"))
    return out


def row_cell(initial: str, fault: int) -> Cell:
    """The cell of one row: kept, reroled or deleted, with insertions on both sides."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        edits = [("K", 0, initial), *(("R", REROLE, role) for role in "ua")]
        for letter, cost, role in edits:
            for p in range(4):
                q = STEP.get((p, role))
                if q is not None:
                    cell[p, q] = min(cell.get((p, q), (1 << 30, "")), (cost + more, letter))
    closed = _insertions()
    return combine(combine(closed, cell), closed)


def span(cells: list[Cell]) -> Cell:
    """The cell of a sequence of spans, by length: pairs of neighbours first."""
    while len(cells) > 1:
        cells = [combine(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


def repeated(cell: Cell, times: int) -> Cell:
    """The cell of ``times`` equal spans."""
    out = None
    while times:
        if times & 1:
            out = cell if out is None else combine(out, cell)
        times >>= 1
        cell = combine(cell, cell) if times else cell
    return out


def parser() -> Callable[[list[tuple[str, int, int]]], Cell]:
    """A function from runs of equal rows (initial, fault, number) to the cell of all."""
    leaves: dict[tuple[str, int], Cell] = {}
    memo: dict[tuple, Cell] = {}

    def leaf(initial: str, fault: int, times: int) -> Cell:
        key = (initial if initial in "sua" else "", fault)
        if key not in leaves:
            leaves[key] = row_cell(*key)
        return leaves[key] if times == 1 else repeated(leaves[key], times)

    def parse(runs: list[tuple[str, int, int]]) -> Cell:
        if len(runs) > 16:
            return span([leaf(*r) for r in runs])
        key = tuple(runs)
        if key not in memo:
            if len(memo) >= MEMO:
                memo.clear()
            memo[key] = span([leaf(*r) for r in runs])
        return memo[key]

    return parse


# ----------------------------------------------------------------- rows and faults


def _plain(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with a space in place of null roles and texts."""
    return rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with a fault dealt to each row by ``crc32(conv_id:turn) % 20``.

    0 drops it, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    dealt = _plain(conversations).withColumn("_k", F.crc32(key) % 20).filter(F.col("_k") != 0)
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_n")).drop("_n")


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows without texts, equal ones as one with their number ``n``, in ranges of (conversation, turn)."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    slim = _plain(rows).select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    equal = slim.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = equal.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("first.turn").alias("_first"), F.lit(True).alias("_some"))
    met = (F.col("conv_id").eqNullSafe(F.col("_c"))) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    seen = F.coalesce(F.col("_some"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("_first"))
    flagged = equal.join(first, met, "left").select("conv_id", "turn", "role", "digest", "n", "blank", "cut", seen.alias("seen"))
    return flagged.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "n", "blank", "cut", "seen")


#: What is known of a part of a conversation beside its cell.
PART = (
    "segment long, first string, last string, first_turn long, last_turn long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, cell array<struct<enter: int, leave: int, cost: long, audit: string>>"
)
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list]]:
    """Rows (as tuples) of each run of equal first columns; a run's rows are an iterator that has to be used up."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def run() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                yield ahead
                ahead = next(rows, None)

        yield key, run()


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 10_000, size: Callable[[tuple], int] = lambda _: 1, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    part, weight = [], 0
    for r in rows:
        part.append(r)
        weight += size(r)
        if len(part) >= most or weight >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part, weight = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _part(key: object, rows: Iterator[tuple], segment: int, parse: Callable[[list], Cell]) -> tuple:
    runs, first, last, low, high, turns = [], None, None, None, None, 0
    blank = duplicate = truncated = illegal = 0
    for _, turn, initial, n, is_blank, is_cut, seen in rows:
        if first is None:
            first = initial
        elif last + initial not in LEGAL_PAIRS:
            illegal += 1
        illegal += n - 1  # no role follows itself
        last = initial
        if turn is not None and turn != high:
            low, high, turns = turn if low is None else low, turn, turns + 1
        later = n if seen else n - 1
        if is_blank:
            blank += n
            runs.append((initial, GONE, n))
            continue
        duplicate += later
        if not seen:
            truncated += is_cut
            runs.append((initial, CUT if is_cut else SOUND, 1))
        if later:
            runs.append((initial, GONE, later))
    cell = [{"enter": p, "leave": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in parse(runs).items()]
    return key, segment, first, last, low, high, turns, blank, duplicate, truncated, illegal, cell


def _whole(key: object, parts: Iterator[tuple]) -> tuple:
    """The summary of a conversation from its parts in order."""
    cells, last, low, high, turns = [], None, None, None, 0
    blank = duplicate = truncated = illegal = 0
    for _, _, first, end, first_turn, last_turn, n, *counts, cell in parts:
        if last is not None and last + first not in LEGAL_PAIRS:
            illegal += 1
        last = end
        if first_turn is not None:
            turns += n - (first_turn == high)
            low, high = first_turn if low is None else low, last_turn
        blank, duplicate, truncated, illegal = (x + y for x, y in zip((blank, duplicate, truncated, illegal), counts, strict=True))
        cells.append({(c["enter"], c["leave"]): (c["cost"], c["audit"]) for c in cell})
    found = span(cells)
    cost, audit = min(found[0, q] for q in LEGAL_END if (0, q) in found)
    return key, 0 if low is None else high - low + 1 - turns, blank, duplicate, truncated, illegal, cost, audit


def parsed(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): ``gaps, blank, duplicate, truncated, illegal, cost, audit``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    key = StructType([f for f in rows.schema.fields if f.name == "conv_id"])
    part, summary = (StructType(key.fields + StructType.fromDDL(x).fields) for x in (PART, SUMMARY))
    part_arrow, summary_arrow = to_arrow_schema(part), to_arrow_schema(summary)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse, segment = parser(), TaskContext.get().partitionId()
        yield from _batched((_part(k, r, segment, parse) for k, r in _runs(batches)), part_arrow, 10_000, lambda r: sum(len(c["audit"]) for c in r[-1]))

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((_whole(k, r) for k, r in _runs(batches)), summary_arrow, 10_000, lambda r: len(r[-1]))

    found = _ordered(rows).mapInArrow(parts, part)
    return found.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "segment").mapInArrow(wholes, summary)


# ------------------------------------------------------------------------ repair

REPAIRED = "place long, edit string, role string, text string"


def _edited(key: object, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The repaired rows of a conversation, whose first row has the audit."""
    audit = next(rows)[-1]
    if audit is None:
        raise ValueError("rows of a conversation that was not parsed")
    odd = (len(audit) - audit.count("D")) % 2
    place = 0

    def role() -> str:
        return "assistant" if (place - odd) % 2 else "user"

    def inserted(at: int) -> int:
        end = at
        while end < len(audit) and audit[end] == "I":
            end += 1
        return end

    at = 0
    for _, _, said_by, text, _ in rows:
        for _ in range(inserted(at) - at):
            yield key, place, "I", role(), ""
            place += 1
            at += 1
        edit = audit[at]
        at += 1
        if edit != "D":
            yield key, place, edit, said_by if edit == "K" else role(), text
            place += 1
    for _ in audit[at:]:
        yield key, place, "I", role(), ""
        place += 1


def _edit(rows: DataFrame, audits: DataFrame, schema: StructType, then: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    said = _plain(rows).select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "text", F.lit(None).cast("string").alias("audit"), F.unhex(F.sha2("text", 256)).alias("digest"))
    first = audits.select("conv_id", F.lit(0).alias("_kind"), *(F.lit(None).cast(said.schema[c].dataType).alias(c) for c in ("turn", "role", "text")), "audit", F.lit(None).cast("binary").alias("digest"))
    order = _order()
    both = said.unionByName(first).repartition("conv_id").sortWithinPartitions(order[0], F.col("_kind"), *order[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edited = (r for k, rows in _runs(batches) for r in _edited(k, rows))
        yield from _batched(then(edited), arrow, 10_000, lambda r: len(r[-1]))

    return both.select("conv_id", "turn", "role", "text", "audit").mapInArrow(run, schema)


def repaired(rows: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """The repaired rows of all conversations: ``conv_id, place, edit, role, text``; ``audits``: the result of :func:`parsed`, if at hand."""
    key = StructType([f for f in rows.schema.fields if f.name == "conv_id"])
    schema = StructType(key.fields + StructType.fromDDL(REPAIRED).fields)
    return _edit(rows, parsed(rows) if audits is None else audits, schema, lambda r: r)


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(conv_id, SHA-256)`` of the repaired rows as lines ``role:text``."""
    started, key, digest = False, None, None
    for k, _, _, role, text in rows:
        if not started or k != key:
            if started:
                yield key, digest.hexdigest()
            started, key, digest = True, k, hashlib.sha256()
        else:
            digest.update(b"\n")
        digest.update(f"{role}:{text}".encode())
    if started:
        yield key, digest.hexdigest()


def repair_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Per conversation with repaired rows the SHA-256 of these, as lines ``role:text``."""
    key = StructType([f for f in rows.schema.fields if f.name == "conv_id"])
    return _edit(rows, audits, StructType(key.fields + StructType.fromDDL("repaired_sha256 string").fields), _digests)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(source)
    audits = materialize(parsed(rows), "audits")
    none = hashlib.sha256().hexdigest()
    known = source.select("conv_id").distinct()
    parts = [known, audits, repair_digests(rows, audits)]
    renamed = [p.withColumnRenamed("conv_id", f"_c{k}") if k else p for k, p in enumerate(parts)]
    out = reduce(lambda x, y: x.join(y[1], F.col("conv_id").eqNullSafe(F.col(f"_c{y[0]}")), "left"), enumerate(renamed[1:], 1), renamed[0])
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in longs), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
