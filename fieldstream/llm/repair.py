"""Conversation structure repair by weighted interval parsing.

A conversation is the sequence of its rows in order of turn (nulls first; equal turns
by role and text, of texts that share ORDER_BYTES bytes by digest). A row's first fault counts: blank (no character but white space),
duplicate (role and text seen earlier), truncated (its last character that is no white
space ends no sentence). A repair keeps, reroles or deletes each row and inserts empty
rows of user or assistant, so that role initials read (s?(ua)+)?.

The grammar is in Chomsky normal form over spans of rows. Its symbols [p>q] say that a
span's rows take the reader from state p to state q (nothing, after s, after u, after
a); [p>q] becomes [p>r] [r>q] for adjacent spans, one edited row, or insertions alone,
by whose closure every row's cell is completed on both sides. A cell holds the least
(cost, audit), audit being the initials of the edits in order. Within a span, audits of
equal cost are never prefixes of one another, as one more insertion costs more; so least
cells join to least cells. Cells are filled bottom-up by span length, 1, 2, 4, ...: a
reader is in one state at each place, so every split of a span gives the same cell, and
one is enough.

Conversations of up to LONG_ROWS rows are gathered by id, sorted by Spark, and parsed as
a task's rows pass by; what was parsed before is remembered by its symbols. Rows of
longer ones are dealt by ranges of their order, whatever their conversation, and cut
into segments; duplicates are found by grouping; each segment is parsed by itself, and
cells are joined over FAN segments at a time. The digest of the repaired text needs its
rows in order, so they pass one task as a stream that holds the audit and no rows.

Defined results: nulls of role and text are one space; null ids are one conversation;
rows whose turn is null come first and count in no gap; roles with other initials than
s, u or a are never kept, a role is kept as it is written otherwise; a repeated row is a
duplicate; an empty conversation has the empty audit and text; bytes that are no UTF-8
are taken as they are; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settled

#: Rows of a conversation that one task parses whole, rows of a segment of a longer one, and segments joined at a time.
LONG_ROWS, SEGMENT_ROWS, FAN = 4096, 4096, 64
#: Bytes of a text that order rows of equal turn and role.
ORDER_BYTES = 200
#: Parses that a worker remembers, and rows of the longest of them.
REMEMBERED, REMEMBERED_ROWS = 50_000, 64

RESULT_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_BEGIN, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after a row of an initial.
_NEXT = {(_BEGIN, "s"): _SYSTEM, (_BEGIN, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_ROLES = {_USER: b"user", _ASSISTANT: b"assistant"}
_LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NO_FAULT, BLANK, DUPLICATE, CUT = "-bdt"

Cell = dict[tuple[int, int], tuple[int, str]]


def join(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans."""
    out: Cell = {}
    for (p, r), (a, x) in left.items():
        for (r2, q), (b, y) in right.items():
            if r == r2:
                found = (a + b, x + y)
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def _closure() -> Cell:
    """The cell of a span without rows: insertions alone."""
    one = {(p, p): (0, "") for p in range(4)} | {(p, q): (INSERT, "I") for (p, c), q in _NEXT.items() if c in "ua"}
    return join(join(one, one), one)


EMPTY = _closure()


def row_cell(initial: str, fault: str) -> Cell:
    """The cell of one row, insertions on both sides included."""
    own: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        for (p, c), q in _NEXT.items():
            if c in "ua":
                own[p, q] = (REROLE + more, "R")
            if c == initial:
                own[p, q] = (more, "K")
    return join(join(EMPTY, own), EMPTY)


_ROW_CELLS = {i + f: row_cell(i, f) for i in "sua?" for f in (NO_FAULT, BLANK, DUPLICATE, CUT)}


def parsed(symbols: list[str]) -> Cell:
    """The cell of all rows, each given as its initial and fault, bottom-up by span length."""
    cells = [_ROW_CELLS[s] for s in symbols] or [EMPTY]
    while len(cells) > 1:
        pairs = [join(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0]


def best(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min(cell[_BEGIN, q] for q in (_BEGIN, _ASSISTANT) if (_BEGIN, q) in cell)


_known: dict[str, tuple[int, str]] = {}


def repair_of(symbols: list[str]) -> tuple[int, str]:
    if len(symbols) > REMEMBERED_ROWS:
        return best(parsed(symbols))
    key = "".join(symbols)
    if key not in _known:
        if len(_known) >= REMEMBERED:
            _known.clear()
        _known[key] = best(parsed(symbols))
    return _known[key]


def initial_of(role: bytes) -> str:
    first = role[:1].decode("latin-1")
    return first if first in ("s", "u", "a") else "?"


def fault_of(text: bytes, seen: bool) -> str:
    shown = text.rstrip(_SPACE)
    return BLANK if not shown else DUPLICATE if seen else NO_FAULT if shown[-1:] in (b".", b"!", b"?") else CUT


class Repaired:
    """Applies an audit to rows as they pass: which roles stand where, and the digest of the repaired text."""

    def __init__(self, audit: str, sink: Callable[[bytes], None]) -> None:
        self.edits, self.sink, self.state, self.first = iter(audit), sink, _BEGIN, True

    def _put(self, role: bytes, text: bytes) -> None:
        self.sink((b"" if self.first else b"\n") + role + b":" + text)
        self.first = False

    def _insert(self) -> None:
        self.state = _ASSISTANT if self.state == _USER else _USER
        self._put(_ROLES[self.state], b"")

    def row(self, role: bytes, text: bytes) -> None:
        while (edit := next(self.edits)) == "I":
            self._insert()
        if edit == "K":
            self.state = _NEXT[self.state, initial_of(role)]
            self._put(role, text)
        elif edit == "R":
            self.state = _ASSISTANT if self.state == _USER else _USER
            self._put(_ROLES[self.state], text)

    def end(self) -> None:
        for _ in self.edits:
            self._insert()


@dataclass
class Facts:
    """Counts over rows in order, which join to those of the rows that follow."""

    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys((BLANK, DUPLICATE, CUT, NO_FAULT), 0))
    turns: tuple[int, int, int] | None = None  # first, last, distinct
    illegal: int = 0
    ends: tuple[str, str] | None = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        self.faults[fault] += 1
        self.join(Facts({}, None if turn is None else (turn, turn, 1), 0, (initial, initial)))

    def join(self, later: Facts) -> None:
        for fault, n in later.faults.items():
            self.faults[fault] += n
        if later.turns:
            a, b = self.turns or (later.turns[0], later.turns[0] - 1, 0), later.turns
            self.turns = (a[0], b[1], a[2] + b[2] - (a[1] == b[0]))
        if later.ends:
            self.illegal += later.illegal + (self.ends is not None and self.ends[1] + later.ends[0] not in _LEGAL)
            self.ends = ((self.ends or later.ends)[0], later.ends[1])

    @property
    def gaps(self) -> int:
        return self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0

    def counts(self) -> tuple[int, int, int, int, int]:
        return (self.gaps, *(self.faults[f] for f in (BLANK, DUPLICATE, CUT)), self.illegal)


def repair(rows: list[tuple[int | None, bytes, bytes]]) -> tuple[Facts, int, str, str]:
    """Counts, cost, audit and digest of a conversation's rows (turn, role, text) in order."""
    facts, seen, symbols = Facts(), set(), []
    for turn, role, text in rows:
        initial, fault = initial_of(role), fault_of(text, (role, text) in seen)
        seen.add((role, text))
        facts.add(turn, initial, fault)
        symbols.append(initial + fault)
    cost, audit = repair_of(symbols)
    digest = sha256()
    made = Repaired(audit, digest.update)
    for _, role, text in rows:
        made.row(role, text)
    made.end()
    return facts, cost, audit, digest.hexdigest()


# ---- tables ---------------------------------------------------------------------------------


def damaged(rows: DataFrame, modulus: int = 20) -> DataFrame:
    """Rows with the faults that the crc32 of `conv_id:turn` gives them, as (conv_id, turn, role, text, copies); a dropped row has copies 0."""
    blank = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(place.cast("binary")) % modulus
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).cast("binary").alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).cast("binary").alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _order() -> tuple[Column, ...]:
    return F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.substring("text", 1, ORDER_BYTES).asc(), F.sha2("text", 256).asc()


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for k in kinds]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True)


def _short(rows: DataFrame) -> DataFrame:
    """Repairs of conversations that are held whole, a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, group in groupby(_tuples(batches), key=lambda r: r[0]):
            facts, cost, audit, digest = repair([r[1:4] for r in group for _ in range(r[4])])
            out.append((conv_id, *facts.counts(), cost, audit, digest))
            if len(out) >= 1000:
                yield _table(out, RESULT_SCHEMA)
                out = []
        yield _table(out, RESULT_SCHEMA)

    return rows.repartition("conv_id").sortWithinPartitions(*_order()).select("conv_id", "turn", "role", "text", "copies").mapInArrow(run, RESULT_SCHEMA)


_SEGMENT = "conv_id long, segment long, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long, first_initial string, last_initial string, " + ", ".join(f"cost_{p}{q} long, audit_{p}{q} string" for p in range(4) for q in range(4))


def _segment_row(conv_id: int | None, segment: int, facts: Facts, cell: Cell) -> tuple:
    cells = [x for p in range(4) for q in range(4) for x in cell.get((p, q), (None, None))]
    return (conv_id, segment, *(facts.faults[f] for f in (BLANK, DUPLICATE, CUT)), facts.illegal, *(facts.turns or (None,) * 3), *(facts.ends or (None, None)), *cells)


def _segment_of(row: tuple) -> tuple[Facts, Cell]:
    facts = Facts({BLANK: row[2], DUPLICATE: row[3], CUT: row[4]}, None if row[6] is None else row[6:9], row[5], None if row[9] is None else row[9:11])
    return facts, {(i // 4, i % 4): (row[11 + 2 * i], row[12 + 2 * i]) for i in range(16) if row[11 + 2 * i] is not None}


def _joined(key: tuple, batch: pa.Table) -> pa.Table:
    """One segment row from those of a conversation that follow one another."""
    facts, cell = Facts(), EMPTY
    for row in sorted(_tuples(iter([batch])), key=lambda r: r[1]):
        later, own = _segment_of(row)
        facts.join(later)
        cell = join(cell, own)
    return pa.Table.from_batches([_table([_segment_row(key[0].as_py(), key[1].as_py(), facts, cell)], _SEGMENT)])


def _long(rows: DataFrame) -> DataFrame:
    """Repairs of conversations of any length, their rows dealt by ranges of the order."""
    keys = ("conv_id", "turn", "role", "text")
    rows = rows.where("copies > 0").groupBy(*keys).agg(F.sum("copies").alias("copies"))  # equal rows are neighbours
    ordered = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).withColumn("at", F.monotonically_increasing_id())
    ordered = settled(ordered.withColumn("digest", F.sha2("text", 256)))
    again = ordered.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = again.select(*[F.col(c).alias(f"again_{c}") for c in ("conv_id", "role", "digest")], "first")

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([(*r[:3], initial_of(r[3]) + fault_of(r[4], False), *r[3:4], *r[5:]) for r in _tuples(iter([batch]))], "conv_id long, at long, turn long, symbol string, role binary, digest string, copies long")

    narrow = ordered.select("conv_id", "at", "turn", "role", "text", "digest", "copies").mapInArrow(symbols, "conv_id long, at long, turn long, symbol string, role binary, digest string, copies long")
    same = F.col("conv_id").eqNullSafe(F.col("again_conv_id")) & (F.col("role") == F.col("again_role")) & (F.col("digest") == F.col("again_digest"))
    flagged = narrow.join(again, same, "left").select("conv_id", F.shiftright("at", SEGMENT_ROWS.bit_length() - 1).alias("segment"), "at", "turn", "symbol", "copies", F.coalesce(F.col("first") < F.col("at"), F.lit(False)).alias("seen"))

    def segment(key: tuple, rows: pa.Table) -> pa.Table:
        facts, found = Facts(), []
        for _, _, _, turn, symbol, copies, seen in sorted(_tuples(iter([rows])), key=lambda r: r[2]):
            for copy in range(copies):
                own = symbol if symbol[1] == BLANK or not (seen or copy) else symbol[0] + DUPLICATE
                facts.add(turn, *own)
                found.append(own)
        return pa.Table.from_batches([_table([_segment_row(key[0].as_py(), key[1].as_py(), facts, parsed(found))], _SEGMENT)])

    segments = settled(flagged.groupBy("conv_id", "segment").applyInArrow(segment, _SEGMENT))
    while (segments.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > 1:
        nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("segment"))  # a row for SEGMENT_ROWS rows
        segments = settled(segments.withColumn("segment", F.floor((nth - 1) / FAN)).groupBy("conv_id", "segment").applyInArrow(_joined, _SEGMENT))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _tuples(batches):
            facts, cell = _segment_of(row)
            yield _table([(row[0], *facts.counts(), *best(cell))], RESULT_SCHEMA.rpartition(",")[0])

    results = settled(segments.mapInArrow(whole, RESULT_SCHEMA.rpartition(",")[0]))
    audits = results.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(b"").alias("role"), F.col("audit").cast("binary").alias("text"), F.lit(1).cast("long").alias("copies"))
    stream = ordered.select("conv_id", "at", "role", "text", "copies").unionByName(audits)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, group in groupby(_tuples(batches), key=lambda r: r[0]):
            digest = sha256()
            made = Repaired(next(group)[3].decode(), digest.update)
            for _, _, role, text, copies in group:
                for _ in range(copies):
                    made.row(role, text)
            made.end()
            yield _table([(conv_id, digest.hexdigest())], "digest_id long, repaired_sha256 string")

    hashed = stream.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "at").mapInArrow(digests, "digest_id long, repaired_sha256 string")
    return results.join(hashed, F.col("conv_id").eqNullSafe(F.col("digest_id"))).drop("digest_id")


def repaired(rows: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """Repairs (RESULT_SCHEMA) of conversations given as (conv_id, turn, role, text, copies), role and text binary; one row a conv_id, also of rows with copies 0 alone."""
    long = settled(rows.groupBy("conv_id").agg((F.sum("copies") + F.count("*")).alias("n")).where(F.col("n") > long_rows).select(F.col("conv_id").alias("long_id")))
    if long.isEmpty():
        return _short(rows)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _short(rows.join(long, same, "left_anti")).unionByName(_completed(_long(rows.join(long, same, "left_semi")), long))


def _completed(found: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each of the ids, those of nothing left included."""
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(sha256().hexdigest())}
    columns = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    full = ids.join(found, F.col("conv_id").eqNullSafe(F.col("long_id")), "left")
    return full.select(F.col("long_id").alias("conv_id"), *[F.coalesce(F.col(c), none.get(c, F.lit(0))).alias(c) for c in columns[1:]])
