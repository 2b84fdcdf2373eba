"""Cheapest repair of conversations whose turns should read (system)? (user assistant)+, or be none at all.

A conversation is a line of turns; each may be kept, given the other role or deleted, and empty turns may be inserted. The search goes
depth first over an explicit stack. A bound on what the rest must cost at least, found in one pass from the end, cuts branches that can't
reach the incumbent (cost, audit); a table for each node (turns done, what stands last) cuts prefixes that came there at no less cost. Branches
are taken in the order of their letters, so of equally cheap audits the first one found is the ASCII-least.

The search sees a byte for each turn, never its text. Texts are read in a second pass, sorted by Spark and handled turn by turn, so that a
conversation of any length needs memory for its bytes only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import ship
from panelloom.sources.storage import materialize

#: What edits cost, and an undeleted truncated turn.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: What stands last: nothing, the system's turn, the user's, the assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: A turn's byte: its role's initial, and 4 times its fault.
_ROLE = {"u": 0, "a": 1, "s": 2}
_FINE, _BLANK, _DUPLICATE, _CUT = range(4)
_SPACES = " \t\n\x0b\x0c\r"


def _after(last: int) -> int:
    """What stands last once the next legal user or assistant turn is there."""
    return _ASSISTANT if last == _USER else _USER


def _kept(role: int, last: int) -> int | None:
    """What stands last once a turn of this role is kept; None where it is not legal."""
    if role == 2:
        return _SYSTEM if last == _START else None
    return _after(last) if (role == 1) == (last == _USER) and role < 2 else None


def _edits(turn: int, last: int) -> list[tuple[str, int, int]]:
    """Edits of one turn in the order of their letters: letter, cost, what stands last."""
    role, fault = turn & 3, turn >> 2
    found = [("D", DELETE, last)]
    if fault not in (_BLANK, _DUPLICATE):
        extra, kept = TRUNCATED if fault == _CUT else 0, _kept(role, last)
        if kept is not None:
            found.append(("K", extra, kept))
        found.append(("R", REROLE + extra, _after(last)))
    return found


_EDITS = [[_edits(turn, last) for last in range(4)] for turn in range(16)]


def suffix_bounds(turns: bytes) -> list[tuple[int, int, int, int]]:
    """For each number of turns done, and what stands last, what the rest costs at least.

    The rest is relaxed: a system's turn may stand alone, so that after it the same is due as after an assistant's.
    """
    bounds = [(0, 0, INSERT, 0)]
    for turn in reversed(turns):
        then = bounds[-1]
        start, user, assistant = (min(cost + then[to] for _, cost, to in _EDITS[turn][last]) for last in (_START, _USER, _ASSISTANT))
        start, user, assistant = min(start, INSERT + user), min(user, INSERT + assistant), min(assistant, INSERT + user)
        bounds.append((start, assistant, user, assistant))
    bounds.reverse()
    return bounds


def _branches(turns: bytes, done: int, last: int) -> list[tuple[str, int, int, int]]:
    """Letter, cost, turns done, what stands last; by letters."""
    insert = ("I", INSERT, done, _after(last))
    if done == len(turns):
        return [insert]
    delete, *others = [(letter, cost, done + 1, to) for letter, cost, to in _EDITS[turns[done]][last]]
    return [delete, insert, *others]


def _greedy(turns: bytes, bounds: list) -> tuple[int, str]:
    """A first incumbent: always the branch that promises least."""
    done, last, spent, audit = 0, _START, 0, []
    while done < len(turns) or last in (_SYSTEM, _USER):
        letter, cost, done, last = min(_branches(turns, done, last), key=lambda b: (b[1] + bounds[b[2]][b[3]], b[0]))
        spent += cost
        audit.append(letter)
    return spent, "".join(audit)


def cheapest(turns: bytes) -> tuple[int, str]:
    """Least cost of making `turns` legal, and the ASCII-least audit of that cost."""
    bounds = suffix_bounds(turns)
    incumbent, proved = _greedy(turns, bounds), False
    reached: list[list[int | None]] = [[None] * 4 for _ in range(len(turns) + 1)]
    path: list[str] = []
    stack = [("", 0, 0, _START, 0)]
    while stack:
        letter, spent, done, last, depth = stack.pop()
        least = spent + bounds[done][last]
        if least > incumbent[0] or (proved and least == incumbent[0]):
            continue
        before = reached[done][last]
        if before is not None and before <= spent:  # came here by smaller letters at no more cost
            continue
        reached[done][last] = spent
        del path[max(0, depth - 1):]
        path.append(letter)
        if done == len(turns) and last in (_START, _ASSISTANT):
            found = (spent, "".join(path))
            if found <= incumbent:
                incumbent, proved = found, True
        for name, cost, to, stands in reversed(_branches(turns, done, last)):
            stack.append((name, spent + cost, to, stands, depth + 1))
    return incumbent


# -- damage --------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by the CRC-32 of `conv_id:turn`: (conv_id, turn, role, text, copy, gone).

    Of 20 remainders 0 drops a turn (it stays as a `gone` row, so that its conversation isn't lost), 1 empties its text, 2 removes
    `.!?` from it, 3 repeats it, 4 makes it the user's. Nulls are one space, but for conv_id and turn themselves.
    """
    name, number, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(name, F.lit(":"), number).cast("binary")) % 20
    gone = kind == 0
    new_text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return conversations.select(
        "conv_id", "turn", F.when(~gone, F.when(kind == 4, "user").otherwise(role)).alias("role"), F.when(~gone, new_text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), gone.alias("gone"))


# -- jobs ----------------------------------------------------------------------------------

def _order() -> list[Column]:
    """The order of a conversation's turns; rows that agree in all of these are alike."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("copy")]


def _keyed(turns: DataFrame) -> DataFrame:
    return turns.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _symbols(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, gone, symbol) with the order's columns: a turn's role and first fault as a byte, no text."""
    trimmed = F.rtrim("text", F.lit(_SPACES))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"), F.asc("copy"))) > 1
    seen = _keyed(turns).select("conv_id", "turn", "role", "digest", "copy", "gone", (trimmed == "").alias("blank"),
                                F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("ended"))
    fault = F.when(F.col("blank"), _BLANK).when(again, _DUPLICATE).when(~F.col("ended"), _CUT).otherwise(_FINE)
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    return seen.select("conv_id", "turn", "role", "digest", "copy", "gone", F.when(F.col("gone"), 0).otherwise(role + 4 * fault).cast("int").alias("symbol"))


@dataclass
class _Counts:
    turns: bytearray
    first: int | None = None
    last: int | None = None
    distinct: int = 0

    def see(self, turn: int | None, symbol: int) -> None:
        self.turns.append(symbol)
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1

    def line(self) -> tuple:
        faults = [sum(s >> 2 == f for s in self.turns) for f in (_BLANK, _DUPLICATE, _CUT)]
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        roles = [s & 3 for s in self.turns]
        illegal = sum((a, b) not in ((2, 0), (0, 1), (1, 0)) for a, b in zip(roles, roles[1:]))
        return (gaps, *faults, illegal, *cheapest(bytes(self.turns)))


_LINE = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def audits(turns: DataFrame) -> DataFrame:
    """One line per conversation of `turns`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    ship(turns.sparkSession)
    schema = T.StructType([turns.schema["conv_id"]] + [T.StructField(c, T.LongType()) for c in _LINE[:-1]] + [T.StructField("audit", T.StringType())])
    types = [pa.int64()] * 6 + [pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        now, held, id_type = nothing, None, None
        for batch in batches:
            names, lines = [], []
            id_type = batch.column(0).type
            for conv, turn, gone, symbol in zip(*(c.to_pylist() for c in batch.columns)):
                if now is nothing or conv != now:
                    if now is not nothing:
                        names.append(now)
                        lines.append(held.line())
                    now, held = conv, _Counts(bytearray())
                if not gone:
                    held.see(turn, symbol)
            if lines:
                yield _lines(names, id_type, lines, types)
        if now is not nothing:
            yield _lines([now], id_type, [held.line()], types)

    sorted_turns = _symbols(turns).repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    return sorted_turns.select("conv_id", "turn", "gone", "symbol").mapInArrow(each, schema)


def _lines(names: list, id_type: pa.DataType, lines: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, id_type), *(pa.array(c, t) for c, t in zip(zip(*lines), types))], ["conv_id", *_LINE])


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns after the edits of `found` (conv_id, audit): conv_id, position, edit (K, R or I), role, text.

    A partition holds whole conversations one after the other, their turns in order.
    """
    ship(turns.sparkSession)
    schema = T.StructType([turns.schema["conv_id"], T.StructField("position", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("edit", "role", "text")])
    texts = _keyed(turns.filter(~F.col("gone"))).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "copy", "text")
    plans = found.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("turn", "role", "digest", "copy")],
                         F.col("audit").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, last, position, out = None, "", 0, _START, 0, []

        def emit(edit: str, role: str, text: str) -> None:
            nonlocal last, position
            kept = _kept(_ROLE.get(role[:1], 3), last) if edit == "K" else _after(last)
            out.append((conv, position, edit, role if edit == "K" else ("user" if kept == _USER else "assistant"), text))
            last, position = kept, position + 1

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                emit("I", "", "")
                at += 1

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for name, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    inserts()  # those at the end of the conversation before
                    conv, audit, at, last, position = name, text, 0, _START, 0
                    continue
                inserts()
                if audit[at] != "D":
                    emit(audit[at], role, text)
                at += 1
            yield _turns(out, id_type)
            out = []
        inserts()
        if out:
            yield _turns(out, id_type)

    ordered = plans.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())
    return ordered.select("conv_id", "kind", "role", "text").mapInArrow(each, schema)


def _turns(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, pa.int64(), pa.string(), pa.string(), pa.string()))],
                                      ["conv_id", "position", "edit", "role", "text"])


def digests(ordered: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns as `repaired` returns them: of `role:text`, joined by line feeds, hashed as they come."""
    schema = T.StructType([ordered.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, id_type = None, None, None
        for batch in batches:
            names, found = [], []
            id_type = batch.column(0).type
            for conv, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 0:
                    if state:
                        names.append(now)
                        found.append(state.hexdigest())
                    now, state = conv, hashlib.sha256()
                state.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, id_type), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], id_type), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    return ordered.select("conv_id", "position", "role", "text").mapInArrow(each, schema)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cheapest repairs of `turns` (conv_id, turn, role, text, copy, gone): the `audits`, stored, and the `repaired` turns.

    Turns stand in the order of `turn` (nulls first), then role, text digest and copy; rows alike in all of these are turns that repeat each other.
    A turn's first fault counts: blank (nothing but ASCII white space), duplicate (same role and text earlier), truncated (the last other character is none of `.!?`).
    Only legal roles by their initials u, a, s may be kept. `gone` rows only name their conversation: one without other rows has zeros and an empty
    audit. A null conv_id is a conversation of its own; other columns are ignored whatever their names; no rows give no rows.
    """
    turns = turns.select("conv_id", "turn", "role", "text", "copy", "gone")
    found = materialize(audits(turns), "audits")
    return found, repaired(turns, found)


def with_digests(found: DataFrame, ordered: DataFrame) -> DataFrame:
    """The audits with repaired_sha256, that of nothing where nothing is left."""
    empty = hashlib.sha256().hexdigest()
    hashed = digests(ordered).withColumnRenamed("conv_id", "_conv")
    joined = found.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select(*found.columns, F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def oracle_sql() -> str:
    """The same by dynamic programming: the least (cost, audit) for each number of turns done and what stands last."""
    rest = "row_number() OVER (PARTITION BY conv_id, l2 ORDER BY c2, a2)"
    return rf"""
    WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
    k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                         lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind FROM conversations, tab),
    d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) - 1 AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM d),
    g AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
    p AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS l, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT conv_id, i, l2, c2, a2, o2 FROM (SELECT conv_id, i + 1 AS i, l2, c2, a2, o2, {rest} AS best FROM (
            SELECT q.conv_id, q.i, CASE e WHEN 'D' THEN q.l WHEN 'R' THEN CASE q.l WHEN 2 THEN 3 ELSE 2 END ELSE CASE g.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS l2,
                q.cost + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS c2, q.audit || e AS a2,
                CASE e WHEN 'D' THEN q.lines WHEN 'R' THEN list_append(q.lines, CASE q.l WHEN 2 THEN 'assistant:' ELSE 'user:' END || g.text) ELSE list_append(q.lines, g.role || ':' || g.text) END AS o2
            FROM (SELECT conv_id, i, CASE n WHEN 0 THEN l WHEN 1 THEN CASE l WHEN 2 THEN 3 ELSE 2 END ELSE CASE l WHEN 2 THEN 2 ELSE 3 END END AS l, cost + 3 * n AS cost, audit || repeat('I', n) AS audit,
                    list_concat(lines, list_slice(CASE l WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END, 1, n)) AS lines FROM p, (VALUES (0), (1), (2)) m(n)) q
            JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id AND g.i = q.i, (VALUES ('D'), ('K'), ('R')) x(e)
            WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR (c = 's' AND q.l = 0) OR (c = 'u' AND q.l <> 2) OR (c = 'a' AND q.l = 2))))) WHERE best = 1),
    n AS (SELECT c.conv_id, count(g.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM g) g ON g.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY 1),
    z AS (SELECT n.conv_id, gaps, blank, duplicate, truncated, illegal, cost + 3 * k AS cost, audit || repeat('I', k) AS audit,
            list_concat(lines, list_slice(CASE l WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END, 1, k)) AS lines,
            CASE k WHEN 0 THEN l WHEN 1 THEN CASE l WHEN 2 THEN 3 ELSE 2 END ELSE CASE l WHEN 2 THEN 2 ELSE 3 END END AS l
        FROM n JOIN p ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.i = n.n, (VALUES (0), (1), (2)) m(k))
    SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
    FROM z WHERE l IN (0, 3) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1"""
