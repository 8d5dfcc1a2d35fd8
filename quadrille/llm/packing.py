"""Packing documents into sequences of equal length: linear grouping on the histogram of lengths, then best fit.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) reaches the driver. It plans
runs: stretches of sequences that hold the same lengths. Executors place pieces by their rank among equal lengths.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ranked, saved, table
from .textkernel import SHINGLED_BYTES, byte_class, slices, words

CAPACITY = 2048
#: Lengths of at least this share of the capacity are large; the smaller ones fill what they leave.
LARGE = 0.4
#: Groups of equal cardinality that large lengths are rounded up in, so distinct sizes of the configuration problem.
GROUPS = 160
#: Hash blocks per length for ranking pieces of equal length.
BLOCKS = 256
#: Words remembered by a worker's tokenizer; beyond that the memory starts anew.
WORDS_KEPT = 300_000
TOKENIZER = "word_bpe_49k.json"
BLANKS = byte_class(b"\t\n\r ")
AS_IT_IS = np.arange(256, dtype=np.uint8)
#: A letter or digit, then ASCII marks (no apostrophe) up to white space.
WORD_THEN_MARKS = r"([\p{L}\p{N}])([!-&(-/:-@\[-`{-~]+)(\s|$)"


# --- the plan, on the driver -------------------------------------------------------------------------------------


@dataclass
class Run:
    """``count`` sequences that all hold the same lengths, in ``parts`` as (length, first rank), and have ``room``."""

    count: int
    room: int
    parts: list[tuple[int, int]] = field(default_factory=list)


def grouped(histogram: dict[int, int], large: int, groups: int) -> tuple[list[int], list[int]]:
    """Sizes and demands after linear grouping: large lengths, longest first, in groups of equal cardinality, each
    rounded up to its longest; a length whose pieces lie in two groups counts in both."""
    todo = sorted(((length, n) for length, n in histogram.items() if length >= large and n), reverse=True)
    total = sum(n for _, n in todo)
    if not total:
        return [], []
    per = -(-total // groups)
    sizes, demands, left = [], [], 0
    for length, n in todo:
        while n:
            if not left:
                sizes.append(length)
                demands.append(0)
                left = per
            take = min(n, left)
            demands[-1] += take
            left -= take
            n -= take
    merged: dict[int, int] = {}
    for s, d in zip(sizes, demands, strict=True):
        merged[s] = merged.get(s, 0) + d
    return list(merged), list(merged.values())


def filled(value: np.ndarray, sizes: list[int], demands: list[int], capacity: int) -> list[int]:
    """The configuration of greatest value that fits: unbounded knapsack over the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = [i for i in range(len(sizes)) if demands[i] > 0 and value[i] > 1e-12]
    if not order:
        return [0] * len(sizes)
    w = np.array([sizes[i] for i in order])
    v = np.array([value[i] for i in order])
    for c in range(int(w.min()), capacity + 1):
        fits = w <= c
        got = best[c - w[fits]] + v[fits]
        k = int(got.argmax())
        best[c] = got[k]
        last[c] = np.flatnonzero(fits)[k]
    out, c = [0] * len(sizes), capacity
    while last[c] >= 0:
        i = order[last[c]]
        out[i] += 1
        c -= sizes[i]
    return out


def simplex(columns: list[list[int]], demands: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Primal and dual solution of min sum(x), A x >= demands, for the few sizes here: the dual problem,
    max demands.y with A'y <= 1 and y >= 0, has the origin as a basis, so a dense tableau needs no first phase."""
    a = np.array(columns, float)  # a row for each configuration
    m, n = a.shape
    t = np.zeros((m + 1, n + m + 1))
    t[:m, :n], t[:m, n : n + m], t[:m, -1] = a, np.eye(m), 1
    t[-1, :n] = -np.array(demands, float)
    basis = list(range(n, n + m))
    for step in range(60 * (n + m)):
        negative = np.flatnonzero(t[-1, :-1] < -1e-9)
        if not len(negative):
            break
        col = int(negative[0] if step > 20 * (n + m) else negative[t[-1, negative].argmin()])
        up = t[:m, col] > 1e-9
        if not up.any():
            break
        ratio = np.where(up, t[:m, -1] / np.where(up, t[:m, col], 1), np.inf)
        row = int(ratio.argmin())
        t[row] /= t[row, col]
        for r in np.flatnonzero(np.abs(t[:, col]) > 1e-12):
            if r != row:
                t[r] -= t[r, col] * t[row]
        basis[row] = col
    y = np.zeros(n)
    for r, b in enumerate(basis):
        if b < n:
            y[b] = t[r, -1]
    return np.maximum(t[-1, n : n + m], 0), y


def configurations(sizes: list[int], demands: list[int], capacity: int, rounds: int = 300) -> list[tuple[list[int], int]]:
    """Column generation over few sizes: the fractional optimum rounded down, and the rest filled greedily."""
    columns = [[capacity // s if i == j else 0 for j in range(len(sizes))] for i, s in enumerate(sizes)]
    for _ in range(rounds):
        x, y = simplex(columns, demands)
        new = filled(y, sizes, demands, capacity)
        if sum(a * b for a, b in zip(new, y, strict=True)) <= 1 + 1e-7 or new in columns:
            break
        columns.append(new)
    x, _ = simplex(columns, demands)
    left, out = list(demands), []
    for column, share in sorted(zip(columns, x, strict=True), key=lambda p: -p[1]):
        n = int(share + 1e-6)
        n = min([n, *(left[i] // k for i, k in enumerate(column) if k)])
        if n > 0:
            out.append((column, n))
            left = [a - n * k for a, k in zip(left, column, strict=True)]
    while any(left):
        column, room = [0] * len(sizes), capacity
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            column[i] = min(left[i], room // sizes[i])
            room -= column[i] * sizes[i]
        n = min(left[i] // k for i, k in enumerate(column) if k)
        out.append((column, n))
        left = [a - n * k for a, k in zip(left, column, strict=True)]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> list[Run]:
    """Runs that hold every piece of the histogram once. Ranks count up within each length."""
    least = max(1, int(capacity * large))
    sizes, demands = grouped(histogram, least, groups)
    runs: list[Run] = []
    # The rounded pieces stand longest first; the places of a size take actual lengths, longest first, so each fits.
    pools = {}
    actual = [[length, 0, n] for length, n in sorted(histogram.items(), reverse=True) if length >= least and n]
    for s, d in sorted(zip(sizes, demands, strict=True), reverse=True):
        pools[s] = pool = []
        while d:
            length, rank, n = actual[0]
            take = min(d, n)
            pool.append([length, rank, take])
            actual[0][1] += take
            actual[0][2] -= take
            d -= take
            if not actual[0][2]:
                actual.pop(0)
    for column, times in configurations(sizes, demands, capacity) if sizes else []:
        places = [s for s, k in zip(sizes, column, strict=True) for _ in range(k)]
        while times:
            # Each place takes from the front of its size's pool; two places of one size take stretches one after the other.
            asked: dict[int, int] = {}
            step = times
            for s in places:
                asked[s] = asked.get(s, 0) + 1
            for s, k in asked.items():
                front = pools[s][0][2]
                step = min(step, front // k if front >= k else 1)
            run = Run(step, capacity)
            for s in places:
                need, got = step, []
                while need:
                    length, rank, n = pools[s][0]
                    take = min(need, n)
                    got.append((length, rank, take))
                    pools[s][0][1] += take
                    pools[s][0][2] -= take
                    need -= take
                    if not pools[s][0][2]:
                        pools[s].pop(0)
                run.parts.append((got[0][0], got[0][1]))
                run.room -= got[0][0]
            runs.append(run)
            times -= step
    return best_fit(runs, {length: n for length, n in histogram.items() if length < least and n}, capacity)


def best_fit(runs: list[Run], small: dict[int, int], capacity: int) -> list[Run]:
    """Put small pieces, longest first, where least room is left after them; new sequences only when none has room.
    Sequences of equal room and content move together, so the work follows the number of lengths, not of pieces."""
    by_room: dict[int, list[Run]] = {}
    for r in runs:
        by_room.setdefault(r.room, []).append(r)
    rooms = sorted(by_room)

    def put(run: Run) -> None:
        if run.room not in by_room:
            bisect.insort(rooms, run.room)
            by_room[run.room] = []
        by_room[run.room].append(run)

    for length in sorted(small, reverse=True):
        n, rank = small[length], 0
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                deep = capacity // length
                put(Run(max(1, n // deep), capacity))
                continue
            room = rooms[at]
            run = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            # Best fit fills the same sequence on while it is the tightest: as many copies as fit and exist.
            deep = min(room // length, max(1, n // run.count))
            take = min(run.count, n // deep)
            if take < run.count:
                put(Run(run.count - take, room, [(p[0], p[1] + take) for p in run.parts]))
            filled_run = Run(take, room - deep * length, list(run.parts))
            for _ in range(deep):
                filled_run.parts.append((length, rank))
                rank += take
                n -= take
            put(filled_run)
    return [r for room in rooms for r in by_room[room]]


@dataclass
class Places:
    """For each length, the ranks at which stretches begin, with the first sequence and the offset of each."""

    begin: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]


def places(runs: list[Run]) -> tuple[Places, int]:
    found: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for run in runs:
        at = 0
        for length, rank in run.parts:
            found.setdefault(length, []).append((rank, first, at))
            at += length
        first += run.count
    made = Places({}, {}, {})
    for length, rows in found.items():
        a = np.array(sorted(rows), np.int64)
        made.begin[length], made.sequence[length], made.offset[length] = a[:, 0], a[:, 1], a[:, 2]
    return made, first


# --- tokens and pieces, on the executors -------------------------------------------------------------------------


class WordCoder:
    """Token ids of whole texts by way of their blank-separated words, each distinct word being encoded once.

    The vocabulary's normaliser and splitter never join across white space, so a text's ids are those of its words
    in turn. Only ASCII white space separates here; the tokenizer sees any other within its word. Case of ASCII
    letters and punctuation at a word's end are taken apart first, which changes no ids, as the splitter parts them
    too; texts with combining marks (or the one letter that lower case turns into some) or what may be a special token
    are left as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.known = 0
        self.sizes, self.starts, self.flat = Grown(np.int64), Grown(np.int64), Grown(np.uint32)

    def learn(self, hashes: list[int], new: list[str]) -> None:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        added = np.fromiter(map(len, made), np.int64, len(made))
        self.starts.add(self.flat.size + np.cumsum(added) - added)
        self.sizes.add(added)
        self.flat.add(np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(added.sum())))
        self.number.update(zip(hashes, range(self.known, self.known + len(made)), strict=True))
        self.known += len(made)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more at the end)."""
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), WORD_THEN_MARKS, r"\1 \2\3")
        w = words(pc.if_else(pc.match_substring_regex(texts, r"\p{M}|\x{130}|<\|"), texts, plain), BLANKS, AS_IT_IS)
        code, distinct = pd.factorize(w.hashes())
        if self.known > WORDS_KEPT:
            self.forget()
        distinct = distinct.tolist()
        new = [k for k, h in enumerate(distinct) if h not in self.number]
        if new:
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            data = w.data.tobytes()
            self.learn([distinct[k] for k in new], [data[w.starts[i] : w.ends[i]].decode() for i in first[new]])
        word = np.fromiter((self.number[h] for h in distinct), np.int64, len(distinct))[code]
        sizes = self.sizes.all()[word]
        ends = np.cumsum(sizes)
        source = np.repeat(self.starts.all()[word] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat.all()[source], np.concatenate(([0], ends))[w.of]


class Grown:
    """An array with room to grow."""

    def __init__(self, kind: type) -> None:
        self.data, self.size = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros(self.size + len(more), self.data.dtype)))
        self.data[self.size : self.size + len(more)] = more
        self.size += len(more)

    def all(self) -> np.ndarray:
        return self.data[: self.size]


_coders: dict[str, WordCoder] = {}


def coder_of(path: str) -> WordCoder:
    """The worker process's coder; tasks that follow in it find their words known."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut each text's ids, ended by ``end``, at every ``capacity`` ids: key, piece, start, length, ids_crc32."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for part, texts in slices(batches, "text", SHINGLED_BYTES):
            ids, bounds = coder.encode(texts)
            rows, number, start, length, crc = [], [], [], [], []
            for d in range(part.num_rows):
                own = np.append(ids[bounds[d] : bounds[d + 1]], np.uint32(end)).astype("<u4")
                for k in range(0, len(own), capacity):
                    cut = own[k : k + capacity]
                    rows.append(d)
                    number.append(k // capacity)
                    start.append(k)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [key, "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every piece of every document: sequence_id and offset beside the columns of ``pieces``.

    Null and empty texts are one piece of the end token; equal documents are placed one by one; an empty table gives
    no rows; other columns of ``df`` are not read. Texts are read once: pieces are saved before ranking.
    """
    cut = saved(pieces(df, path or tokenizer_path(), capacity, key=key, text=text), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where, _ = places(plan(histogram, capacity))
    sent = df.sparkSession.sparkContext.broadcast(where)
    rows = ranked(cut, ["length"], [F.col(key), F.col("piece"), F.col("ids_crc32")], [F.col(key), F.col("piece"), F.col("ids_crc32")], "place", BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("place").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                at = length == v
                i = np.searchsorted(p.begin[v], rank[at], side="right") - 1
                sequence[at] = p.sequence[v][i] + rank[at] - p.begin[v][i]
                offset[at] = p.offset[v][i]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return rows.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
