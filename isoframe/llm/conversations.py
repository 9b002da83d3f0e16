"""Repair of conversations: faults of the turns and the cheapest edits that give a well-formed one.

A conversation is well formed where the initials of its roles are ``(s?(ua)+)?``. Its rows are read in order by an
automaton with four states (start, after s, after u, after a). Edits are Keep, Rerole, Delete and Insert; the audit is
the string of their initials. Of the cheapest edits the audit that is least in ASCII order is taken.

Both wishes are one integer. Its high digits are the cost; its low digits are the audit, D I K R as 1 2 3 4, in one
field of ``FIELD`` digits for each row and one for the end, each field padded with zeros at its end. What a row can
add (some Inserts and then one other letter) is never the beginning of something else it can add, so comparing field
by field is comparing the audits, and an edge of the graph always adds the same number. The least integer over all
paths through the graph (row, state) therefore decides everything, ties included.

The rows of a conversation stream through one task in order, since their hash can't be computed in another way. The
fields that all states agree on are final: they are taken off the integers and their rows are hashed at once, so that
memory and the length of the integers are bounded by the rows still open and not by the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed rule: what can follow what, as (state, initial) -> state. States: 0 start, 1 after s, 2 after u, 3 after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = " DIKR"
DIGIT = 3  # bits of a digit
FIELD = 3  # digits of a row: two Inserts lead from any state to any that can be reached, one letter follows
FIELD_BITS = DIGIT * FIELD
#: From any state the rest of any other can be followed for so much more: a kept s deleted, two Inserts before it.
SPREAD = DELETE + 2 * INSERT
#: Open rows after which the common beginning is looked for.
SETTLE_ROWS = 32


def _wanted(state: int) -> str:
    """Initial of the only role that can be inserted or given in a state."""
    return "a" if state == 2 else "u"


def _number(letters: str) -> int:
    """A field: letters as digits, zeros after them."""
    out = 0
    for x in letters.ljust(FIELD):
        out = (out << DIGIT) | LETTERS.index(x)
    return out


@cache
def edges(initial: str | None, fault: str | None) -> tuple[tuple[int, int, int, int], ...]:
    """(state, next state, cost, field) of all edits of a row; without a row (initial None) those after the last one."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state in range(4):
        at = state
        for inserts in range(FIELD):
            if inserts:
                at = NEXT[at, _wanted(at)]
            if initial is None:
                options = [(0, 0, "")] if at in ENDS else []
            else:
                options = [(at, DELETE, "D")]
                if fault not in ("blank", "duplicate"):
                    stays = TRUNCATED if fault == "truncated" else 0
                    options += [(NEXT[at, initial], KEEP + stays, "K")] if (at, initial) in NEXT else []
                    options += [(NEXT[at, _wanted(at)], REROLE + stays, "R")]
            for to, cost, letter in options:
                found = (cost + inserts * INSERT, _number("I" * inserts + letter))
                best[state, to] = min(found, best.get((state, to), found))
    return tuple((s, t, cost, field) for (s, t), (cost, field) in best.items())


class Repair:
    """Cheapest edits of one conversation, fed row by row; letters come out as soon as they are certain."""

    def __init__(self):
        self._values = {0: 0}  # least integer per state
        self._fields = 0
        self.cost = 0

    def row(self, initial: str | None, fault: str | None) -> None:
        self._fields += 1
        high = self._fields * FIELD_BITS
        values: dict[int, int] = {}
        for s, t, cost, field in edges(initial, fault):
            if s in self._values:
                value = (self._values[s] << FIELD_BITS) + (cost << high) + field
                if t not in values or value < values[t]:
                    values[t] = value
        self._values = values

    def settled(self) -> list[str]:
        """Letters of the first open rows, as far as all states agree on them that can still win."""
        most = (min(self._values.values()) >> (self._fields * FIELD_BITS)) + SPREAD
        self._values = {s: v for s, v in self._values.items() if v >> (self._fields * FIELD_BITS) <= most}
        mask = (1 << (self._fields * FIELD_BITS)) - 1
        first, *others = (v & mask for v in self._values.values())
        differ = max((first ^ d).bit_length() for d in others) if others else 0
        return self._take(self._fields + -differ // FIELD_BITS)

    def end(self) -> list[str]:
        """Letters of all rows still open and, as the last entry, those after the last row."""
        self.row(None, None)
        return self._take(self._fields)

    def _take(self, n: int) -> list[str]:
        bits = self._fields * FIELD_BITS
        digits = next(iter(self._values.values()))
        out = []
        for i in range(1, n + 1):
            field = digits >> (bits - i * FIELD_BITS)
            out.append("".join(LETTERS[(field >> (DIGIT * j)) & 7] for j in reversed(range(FIELD))).rstrip())
        paid = min(self._values.values()) >> bits
        left = bits - n * FIELD_BITS
        self.cost += paid
        self._values = {s: (((v >> bits) - paid) << left) | (v & ((1 << left) - 1)) for s, v in self._values.items()}
        self._fields -= n
        return out


class _Conversation:
    """One conversation on its way through a task: counts, open rows, audit and hash so far."""

    def __init__(self):
        self.repair, self.open, self.audit, self.state = Repair(), [], [], 0
        self.sha, self.lines = hashlib.sha256(), 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.low = self.high = None
        self.turns = 0

    def _write(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def _apply(self, letters: str, row) -> None:
        self.audit.append(letters)
        for x in letters:
            initial = _wanted(self.state)
            if x == "D":
                continue
            if x == "K":
                initial = row[0][:1]
                self._write(*row)
            else:
                self._write(NAMES[initial], row[1] if x == "R" else "")
            self.state = NEXT[self.state, initial]

    def _settle(self, fields: list[str]) -> None:
        for letters, row in zip(fields, self.open):
            self._apply(letters, row)
        del self.open[: len(fields)]

    def add(self, turn, role: str, text: str, fault: str | None, copies: int) -> None:
        if copies and turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        for i in range(copies):
            if i and fault != "blank":
                fault = "duplicate"  # the copy before it has the same role and text
            if fault:
                self.counts[fault] += 1
            initial = role[:1]
            self.illegal += self.before is not None and self.before + initial not in LEGAL
            self.before = initial
            self.repair.row(initial, fault)
            self.open.append((role, text))
            if len(self.open) % SETTLE_ROWS == 0:
                self._settle(self.repair.settled())

    def end(self) -> dict:
        fields = self.repair.end()
        self._settle(fields[:-1])
        self._apply(fields[-1], None)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {
            "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.repair.cost,
            "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest(),
        }


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows (conv_id, turn, role, text, fault, copies) to one row per conversation."""
    key, now, done, kind = None, None, [], None

    def flush():
        columns = {"conv_id": pa.array([k for k, _ in done], kind)}
        for name, type_ in (f.split(" ") for f in _RESULT.split(", ")):
            columns[name] = pa.array([r[name] for _, r in done], pa.int64() if type_ == "long" else pa.string())
        done.clear()
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        names = ("conv_id", "turn", "role", "text", "fault", "copies")
        for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in names)):
            if now is None or conv_id != key:
                if now is not None:
                    done.append((key, now.end()))
                key, now = conv_id, _Conversation()
            now.add(*row)
        if done:
            yield flush()
    if now is not None:
        done.append((key, now.end()))
        yield flush()


def find_faults(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with ``fault``: blank, else duplicate, else truncated, else null.

    Equal rows of a turn are one row with ``copies``; its fault is that of the first of them, the others are duplicates
    unless they are blank. A duplicate has the role and text of an earlier row; rows without copies are no rows.
    """
    same = Window.partitionBy("conv_id", "role", "text")
    there = F.col("copies") > 0
    first = F.min(F.when(there, F.col("turn"))).over(same)
    without_turn = F.max(F.when(there, F.col("turn").isNull())).over(same)
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return turns.withColumn(
        "fault",
        F.when(last == "", F.lit("blank"))
        .when(F.col("turn").isNotNull() & (without_turn | (F.col("turn") > first)), F.lit("duplicate"))
        .when(~last.isin(".", "!", "?"), F.lit("truncated")),
    )


def repair_conversations(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """Faults, cost, audit and hash of the repaired rows of every conversation.

    ``turns`` has conv_id, turn (a whole number), role and text. Each row stands for ``copies`` equal rows that follow
    each other, one without it; a row of 0 copies only says that there is such a conversation. Returns conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, nulls first, and within a turn by role and text (in the order of their UTF-8 bytes). Null roles and
    texts count as one space; the rows with a null conv_id are a conversation like others. Repeated rows are duplicates
    and very long texts are hashed whole. A conversation without rows has zeros, an empty audit and the hash of nothing;
    an empty table gives an empty result. Other columns are not read. Equal rows are counted before the shuffle by
    conversation.
    """
    space = F.lit(" ")
    rows = (
        turns.select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", space).alias("role"),
            F.coalesce("text", space).alias("text"),
            (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
        )
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
        .repartition("conv_id")
    )
    ordered = find_faults(rows).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_stream, f"conv_id {kind}, {_RESULT}")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of their ids: conv_id, turn, role, text, copies (0 where dropped)."""
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.select(
        "conv_id",
        F.when(kind != 0, F.col("turn")).alias("turn"),
        F.when(kind == 4, F.lit("user")).when(kind != 0, role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).when(kind != 0, text).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def op13_query(spark, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair_conversations(rows, F.col("copies"))


OP13_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(8 * length(name)), lambda k: (ascii(name[CAST(k // 8 + 1 AS BIGINT)])::BIGINT >> (k % 8)) & 1)),
      lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 20 AS kind
  FROM named),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM rows_),
seen AS (
  SELECT *, left(role, 1) AS c, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS occurrence,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS c_before
  FROM placed),
faults AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN occurrence > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
ins(s, t, n, cost, letters) AS (VALUES
  (0, 0, 0, 0, ''), (1, 1, 0, 0, ''), (2, 2, 0, 0, ''), (3, 3, 0, 0, ''),
  (0, 2, 1, 3, 'I'), (1, 2, 1, 3, 'I'), (2, 3, 1, 3, 'I'), (3, 2, 1, 3, 'I'),
  (0, 3, 2, 6, 'II'), (1, 3, 2, 6, 'II')),
inserted AS (
  SELECT *, CASE n WHEN 0 THEN '' WHEN 1 THEN CASE WHEN s = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END
            ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END AS lines FROM ins),
follows(s, c, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
given(s, role, t) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
moves AS (
  SELECT conv_id, i, s, s AS t, 4 AS cost, 'D' AS letter, '' AS line FROM faults, (VALUES (0), (1), (2), (3)) AS v(s)
  UNION ALL
  SELECT conv_id, i, s, t, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text
  FROM faults JOIN follows USING (c) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, i, s, t, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', chr(10) || g.role || ':' || text
  FROM faults, given g WHERE fault NOT IN ('blank', 'duplicate')),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM faults
  UNION ALL
  SELECT conv_id, i, st, best.cost, best.audit, best.lines FROM (
    SELECT w.conv_id, w.i + 1 AS i, m.t AS st,
           min({'cost': w.cost + n.cost + m.cost, 'audit': w.audit || n.letters || m.letter, 'lines': w.lines || n.lines || m.line}) AS best
    FROM walk w JOIN inserted n ON n.s = w.st JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 AND m.s = n.t
    GROUP BY ALL)),
sizes AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (c_before IS NOT NULL AND c_before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
ended AS (
  SELECT w.conv_id, min({'cost': w.cost + n.cost, 'audit': w.audit || n.letters, 'lines': w.lines || n.lines}) AS best
  FROM walk w JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.i JOIN inserted n ON n.s = w.st
  WHERE n.t IN (0, 3) GROUP BY w.conv_id)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit,
       sha256(coalesce(substr(e.best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""
