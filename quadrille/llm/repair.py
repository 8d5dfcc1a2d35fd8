"""Conversation structure repair: the cheapest edits that give a conversation's roles the form (s?(ua)+)?.

The edits are arcs of a weighted automaton over the rows: what it costs to go on from each of its four states is a
vector. Vectors less their least cost are the states of a deterministic automaton, which is made as it is needed: a
table remembers, for a vector and a kind of row, the vector before that row and what it costs more. One scan of the
table from the last row to the first gives the costs; the way back goes along arcs that cost exactly what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, table
from .spelling import CRC_SQL, crc_sql

#: States: nothing yet, after system, after user, after assistant. Where each goes by role initial, what may be added,
#: and what it costs to end there.
START, SYSTEM, USER, ASSISTANT = range(4)
GOES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ADDS = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
ENDS = (0, 10, 5, 0)
#: No way there.
NEVER = 1 << 40

#: What counts as blank.
SPACE = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]
#: A kind of row: its role's initial if it is s, u or a, whether it must go, whether it is cut short.
Kind = tuple[str, bool, bool]
GONE: Kind = ("", True, False)


class Determined:
    """The deterministic automaton, made lazily: ``before`` and ``ways`` are its tables."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self.ids: dict[Vector, int] = {}
        self.before: dict[tuple[int, Kind], tuple[int, int]] = {}
        self.ways: dict[tuple[int, Kind, int], tuple[str, int]] = {}

    def state(self, vector: Vector) -> tuple[int, int]:
        """The number of the vector less its least cost, and that cost."""
        least = min(vector)
        normal = tuple(NEVER if v >= NEVER else v - least for v in vector)
        if normal not in self.ids:
            self.ids[normal] = len(self.vectors)
            self.vectors.append(normal)
        return self.ids[normal], least

    def arcs(self, after: Vector, kind: Kind, q: int) -> Iterator[tuple[str, int, int]]:
        """Edits of a row in state q: initial, state after it, cost from here on."""
        initial, must_go, cut = kind
        yield "D", q, DELETE + after[q]
        if not must_go:
            if initial in GOES[q]:
                yield "K", GOES[q][initial], CUT * cut + after[GOES[q][initial]]
            yield "R", ADDS[q], REROLE + CUT * cut + after[ADDS[q]]

    def costs(self, after: Vector, kind: Kind) -> Vector:
        out = [min(min(x[2] for x in self.arcs(after, kind, q)), NEVER) for q in range(4)]
        for _ in range(2):
            out = [min(out[q], INSERT + out[ADDS[q]]) for q in range(4)]
        return tuple(out)

    def scanned(self, kinds: list[Kind], end: Vector) -> tuple[list[int], int]:
        """The state before each row and at the end, and the cost to add to those of the first."""
        state, cost = self.state(end)
        out = [state]
        for kind in reversed(kinds):
            got = self.before.get((state, kind))
            if got is None:
                got = self.before[state, kind] = self.state(self.costs(self.vectors[state], kind))
            state, more = got
            cost += more
            out.append(state)
        return out[::-1], cost

    def way(self, after: int, kind: Kind, q: int) -> tuple[str, int]:
        """The edits at a row, inserts first, of the cheapest ways the least in ASCII order, and the state after it."""
        got = self.ways.get((after, kind, q))
        if got is None:
            vector = self.vectors[after]
            costs, said, at = self.costs(vector, kind), "", q
            while True:
                tight = {letter: to for letter, to, cost in self.arcs(vector, kind, at) if cost == costs[at]}
                if "D" not in tight and costs[at] == INSERT + costs[ADDS[at]]:
                    said, at = said + "I", ADDS[at]
                    continue
                letter = min(tight)
                got = self.ways[after, kind, q] = (said + letter, tight[letter])
                break
        return got

    def traced(self, kinds: list[Kind], states: list[int], q: int) -> tuple[list[str], int]:
        """The edits at each row from state q on, and the state at the end."""
        out = []
        for i, kind in enumerate(kinds):
            said, q = self.way(states[i + 1], kind, q)
            out.append(said)
        return out, q


# --- rows --------------------------------------------------------------------------------------------------------


def judged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The distinct rows (conv, turn, role, text) with the number of copies, and whether a row is blank, repeats an
    earlier one of its conversation, or is cut short. Null roles and texts are one space.

    Copies of one row are counted together before the shuffle; first occurrences are a minimum, joined by the hash of
    the text, so neither a long conversation nor an often repeated row meets in one task.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("what", F.sha2("text", 256))
    rows = saved(rows, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy("conv", "role", "what").agg(F.min(place).alias("first"))
    both = rows.alias("r").join(first.alias("f"), F.col("r.conv").eqNullSafe(F.col("f.conv")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.what") == F.col("f.what")))
    last = F.substring(F.rtrim("r.text", F.lit(SPACE)), -1, 1)
    return both.select("r.conv", "r.turn", "r.role", "r.text", "r.copies", (last == "").alias("blank"), (F.struct(F.col("r.turn").isNotNull().alias("known"), F.col("r.turn").alias("turn")) != F.col("f.first")).alias("again"), (~last.rlike("[.!?]")).alias("cut"))


ORDER = ["conv", "seg", "turn", "role", "text"]
#: A stretch's rows that are written together.
BATCH = 2_000
EDITS = "seg int, line long, edit string, fault string, turn long, was string, role string, text string, cost int"


def _kinds(r: dict) -> list[Kind]:
    one = (r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "", r["blank"] or r["again"], r["cut"] and not r["blank"])
    return [one] + [GONE] * (r["copies"] - 1)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, Iterator[dict]]]:
    """Conversation, stretch and rows, of batches in order."""
    rows = (r for b in batches for r in b.to_pylist())
    for (conv, seg), own in groupby(rows, lambda r: (r["conv"], r["seg"])):
        yield conv, seg, own


def _summed(dealt: DataFrame, kind: str, ends: dict | None = None) -> DataFrame:
    """Without ``ends``: of each stretch the costs from each state on, for each state in which it might end. With the
    costs at the end of each: the state in which it ends, for each state in which it might begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Determined()
        for conv, seg, rows in _stretches(batches):
            kinds, out = [k for r in rows for k in _kinds(r)], []
            if ends is None:
                for q in range(4):
                    states, cost = auto.scanned(kinds, tuple(0 if x == q else NEVER for x in range(4)))
                    out += [min(NEVER, v + cost) for v in auto.vectors[states[0]]]
            else:
                states, _ = auto.scanned(kinds, ends.get((conv, seg), ENDS))
                out = [auto.traced(kinds, states, q)[1] for q in range(4)]
            yield pa.RecordBatch.from_pylist([{"conv": conv, "seg": seg, "out": out}], schema=pa.schema([(n, t) for n, t in (("conv", dealt_type), ("seg", pa.int32()), ("out", pa.list_(pa.int64())))]))

    dealt_type = _arrow(dealt, "conv")
    return dealt.select("conv", "seg", "role", "blank", "again", "cut", "copies").mapInArrow(run, f"conv {kind}, seg int, out array<long>")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _split(dealt: DataFrame, kind: str) -> tuple[dict, dict]:
    """For the stretches of conversations that lie in several: the costs at the end of each but the last, and the state
    in which each begins. A boundary between stretches parts one conversation at most, so these are two a boundary at most,
    however many rows there are, and go through the driver."""
    several = dealt.select("conv", "seg").distinct().groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("own"))
    parts = dealt.join(F.broadcast(several), F.col("conv").eqNullSafe(F.col("own")), "left_semi")
    parts = saved(parts, "parted").repartition("conv", "seg").sortWithinPartitions(*ORDER)
    found: dict[object, list[tuple[int, list[int]]]] = {}
    for r in _summed(parts, kind).collect():
        found.setdefault(r["conv"], []).append((r["seg"], r["out"]))
    ends, starts = {}, {}
    for conv, segs in found.items():
        after = ENDS
        for seg, out in sorted(segs, reverse=True):
            if after is not ENDS:
                ends[conv, seg] = after
            after = tuple(min(out[4 * to + q] + after[to] for to in range(4)) for q in range(4))
    if not ends:
        return ends, starts
    reached = {(r["conv"], r["seg"]): r["out"] for r in _summed(parts, kind, ends).collect()}
    for conv, segs in found.items():
        q = START
        for seg, _ in sorted(segs):
            starts[conv, seg] = q
            q = reached[conv, seg][q]
    return ends, starts


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The cheapest edits of each conversation, as rows in the order of (seg, line): edit (Keep, Rerole, Delete or
    Insert, by its initial), the row's first fault (blank, duplicate, truncated or null), turn and role as they were
    (null for an insert), the role and text after it (null for a delete), and its cost. A row's copies are rows.

    Rows are ordered by turn, null first, then role and text. Keep costs 0, Rerole to user or assistant 1, Delete 2,
    which blank and duplicate rows must take, an Insert of an empty user or assistant 5, and a truncated row that is
    not deleted 5 more. Of equally cheap ways the first in ASCII order of its initials is taken. A role whose initial
    is not s, u or a cannot be kept. No rows give no rows; a null conversation is one of its own.

    Rows are dealt by ranges of this order; a conversation of any length may thus lie in several stretches, whose
    costs are put together from the costs of each between all states.
    """
    kind = turns.schema[conv].dataType.simpleString()
    rows = judged(turns, conv, turn, role, text)
    spread = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]).withColumn("seg", F.spark_partition_id())
    dealt = saved(spread, "dealt")
    ends, starts = _split(dealt, kind)
    own = _arrow(dealt, "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Determined()
        names = ["conv", *[x.split()[0] for x in EDITS.split(", ")]]
        kinds_of = [own, pa.int32(), pa.int64(), *[pa.string()] * 2, pa.int64(), *[pa.string()] * 3, pa.int32()]
        made: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds_of, strict=True)], names)
            made.clear()
            return batch

        for conv, seg, rows in _stretches(batches):
            rows = list(rows)
            kinds = [_kinds(r) for r in rows]
            flat = [k for ks in kinds for k in ks]
            states, _ = auto.scanned(flat, ends.get((conv, seg), ENDS))
            q = starts.get((conv, seg), START)
            line, at = 0, 0
            for r, ks in zip(rows, kinds, strict=True):
                for copy, k in enumerate(ks):
                    said, after = auto.way(states[at + 1], k, q)
                    for letter in said:
                        if letter == "I":
                            q = ADDS[q]
                            made.append((conv, seg, line, "I", None, None, None, ROLE[q], "", INSERT))
                        else:
                            fault = "blank" if r["blank"] else "duplicate" if r["again"] or copy else "truncated" if r["cut"] else None
                            now = None if letter == "D" else r["role"] if letter == "K" else ROLE[after]
                            cost = DELETE if letter == "D" else REROLE * (letter == "R") + CUT * k[2]
                            made.append((conv, seg, line, letter, fault, r["turn"], r["role"], now, None if letter == "D" else r["text"], cost))
                        line += 1
                    q, at = after, at + 1
                    if len(made) >= BATCH:
                        yield out()
            if (conv, seg) not in ends:
                while q in (SYSTEM, USER):
                    q = ADDS[q]
                    made.append((conv, seg, line, "I", None, None, None, ROLE[q], "", INSERT))
                    line += 1
            if len(made) >= BATCH:
                yield out()
        if made:
            yield out()

    return dealt.repartition("conv", "seg").sortWithinPartitions(*ORDER).mapInArrow(run, f"conv {kind}, {EDITS}").withColumnRenamed("conv", conv)


def audits(edits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row of digests for each conversation of edits. The rows of a conversation come in one sorted stream, as a
    hash of its whole text cannot be put together from parts; nothing but the edits' initials is kept of it."""
    kind = edits.schema[conv].dataType.simpleString()
    own = _arrow(edits, conv)
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        done: list[tuple] = []
        types = [own, *[pa.int64()] * 6, pa.string(), pa.string()]
        for conv, own_rows in groupby(rows, lambda r: r["conv"]):
            faults = {"blank": 0, "duplicate": 0, "truncated": 0}
            low = high = before = None
            turns = illegal = cost = lines = 0
            said, digest = bytearray(), hashlib.sha256()
            for r in own_rows:
                said += r["edit"].encode()
                cost += r["cost"]
                if r["edit"] != "I":
                    if r["fault"]:
                        faults[r["fault"]] += 1
                    if before is not None and before + r["was"][:1] not in ("su", "ua", "au"):
                        illegal += 1
                    before = r["was"][:1]
                    if r["turn"] is not None and r["turn"] != high:
                        low, high, turns = r["turn"] if low is None else low, r["turn"], turns + 1
                if r["edit"] != "D":
                    digest.update(f"{'\n' * (lines > 0)}{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
                    lines += 1
            gaps = 0 if low is None else high - low + 1 - turns
            done.append((conv, gaps, *faults.values(), illegal, cost, said.decode(), digest.hexdigest()))
            if len(done) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    stream = edits.withColumnRenamed(conv, "conv").repartition("conv").sortWithinPartitions("conv", "seg", "line")
    schema = f"conv {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", audit string, repaired_sha256 string"
    return stream.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def damaged(turns: DataFrame) -> DataFrame:
    """The damage of the query: by crc32 of 'conv_id:turn' modulo 20 a row is dropped, emptied, loses its [.!?], is
    repeated, or becomes the user's. Nulls are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), d.alias("d")).filter("d <> 0")
    text: Column = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("d") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("time", "times")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    made = audits(repaired(damaged(turns)))
    every = turns.select(F.col("conv_id").alias("every")).distinct()
    both = every.join(made, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("every").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _way(*parts: str) -> str:
    return "list_sort([" + ", ".join(parts) + "])[1]"


def _arc(letter: str, cost: str, line: str, to: str, when: str = "") -> str:
    made = f"{{'c': {cost} + {to}.c, 'a': '{letter}' || {to}.a, 't': {line} || {to}.t}}"
    return f"CASE WHEN {when} THEN {made} ELSE {{'c': {NEVER}, 'a': '', 't': ''}} END" if when else made


def _sql() -> str:
    """Costs to go of the four states (w), row by row from the last, with their edits and lines, least first."""
    free, more = "NOT must", "CASE WHEN cut THEN 5 ELSE 0 END"
    go = lambda q, i: f"w[{GOES[q][i] + 1}]"
    rows = []
    for q in range(4):
        arcs = [_arc("D", "2", "''", f"w[{q + 1}]")]
        arcs += [_arc("K", more, "role || ':' || text || chr(10)", go(q, i), f"{free} AND initial = '{i}'") for i in GOES[q]]
        to = ADDS[q]
        arcs.append(_arc("R", f"1 + {more}", f"'{ROLE[to]}:' || text || chr(10)", f"w[{to + 1}]", free))
        rows.append(f"{_way(*arcs)} AS g{q}")
    add = lambda q, f: _way(f"{f}{q}", _arc("I", "5", f"'{ROLE[ADDS[q]]}:' || chr(10)", f"{f}{ADDS[q]}"))
    end = lambda c, a, t: f"{{'c': {c}::BIGINT, 'a': '{a}', 't': {t}}}"
    last = "[" + ", ".join((end(0, "", "''"), end(10, "II", "'user:' || chr(10) || 'assistant:' || chr(10)"), end(5, "I", "'assistant:' || chr(10)"), end(0, "", "''"))) + "]"
    codes = "list_transform(range(1, length(s) + 1), lambda i: unicode(s[i])::BIGINT)"
    return f"""
WITH RECURSIVE {CRC_SQL},
plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
hit AS (SELECT conv_id, turn, role, text, {crc_sql(codes)} % 20 AS d FROM plain, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER o AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, count(*) OVER (PARTITION BY conv_id) AS rows, lag(role) OVER o AS before,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
told AS (
  SELECT *, left(role, 1) AS initial, last = '' AS blank, last <> '' AND nth > 1 AS again, last <> '' AND NOT regexp_matches(last, '[.!?]') AS cut, last = '' OR nth > 1 AS must FROM placed),
run(conv_id, n, w) AS (
  SELECT DISTINCT conv_id, rows + 1, {last} FROM told
  UNION ALL
  SELECT conv_id, n, [{add(0, 'f')}, {add(1, 'f')}, {add(2, 'f')}, {add(3, 'f')}] FROM (
    SELECT conv_id, n, {', '.join(f"{add(q, 'g')} AS f{q}" for q in range(4))} FROM (
      SELECT t.conv_id, t.n, {', '.join(rows)} FROM run r JOIN told t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.n = r.n - 1))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut AND NOT again) AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w[1].c, 0)::BIGINT AS cost, coalesce(w[1].a, '') AS audit, sha256(coalesce(w[1].t[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN run r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.n = 1
"""


OP13_SQL = _sql()
