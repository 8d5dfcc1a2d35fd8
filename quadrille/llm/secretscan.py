"""Secret scan: credentials by their marks, and others by the format that is inferred from those.

The values found by their marks are labelled credentials. From a bounded sample of each kind a prefix tree is built,
whose statistically compatible states are merged into a probabilistic automaton; one more is inferred from a sample of
other strings. A string is then a credential if an automaton of credentials takes it as readily as it takes its own
sample, and more readily than that of other strings does.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .shared import saved, table

#: Marks of each kind, the least length of its value, and the value's group (fixed values).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: What a text without assignments holds none of.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Strings that might be credentials.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
PLAIN = "plain"
#: Distinct values of a kind, and other strings, from which automata are inferred: those of least crc32, up to a length.
SAMPLE = 2_000
SAMPLE_PLAIN = 20_000
SAMPLE_LENGTH = 200
#: Values of which a kind has no automaton of its own.
LEAST_SAMPLE = 30
#: Risk of keeping two like states apart.
ALPHA = 0.01
#: Weight of what was never seen in a state.
UNSEEN = 0.05
#: Share of the labelled credentials that need not be taken, and of the other sample that may be: of those, some may be
#: credentials without marks.
MISSED, TAKEN = 0.02, 0.01
#: By how much, in nats, a credential must stand out more than all the rest of the other sample.
MARGIN = 4.0
#: States of an automaton that has inferred a format; one state knows frequencies alone.
LEAST_STATES = 2
#: Length up to which strings are scored side by side; longer ones are scored one by one.
SHORT = 256
#: Different strings whose judgement a task remembers.
REMEMBERED = 200_000

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CODE = np.full(256, len(SYMBOLS), np.int64)
CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))


# --- marks -------------------------------------------------------------------------------------------------------


def marked(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and value of the credentials that are known by their marks, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int]]:
    """The strings that touch nothing already found."""
    if not taken:
        yield from (m.span() for m in CANDIDATE.finditer(text))
        return
    spans = sorted((a, b) for a, b, _, _ in taken)
    i = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(spans) and spans[i][1] <= a:
            i += 1
        if i == len(spans) or spans[i][0] >= b:
            yield a, b


# --- inference ---------------------------------------------------------------------------------------------------


class Tree:
    """A prefix tree with counts, and what merging makes of it: how many strings reach a state and end in it, and how
    many go on, and where, by symbol."""

    def __init__(self, strings: Iterable[str]) -> None:
        self.reach, self.end, self.go = [0], [0], [{}]
        for s in strings:
            q = 0
            self.reach[0] += 1
            for c in s:
                edge = self.go[q].get(c)
                if edge is None:
                    edge = self.go[q][c] = [len(self.go), 0]
                    self.reach.append(0)
                    self.end.append(0)
                    self.go.append({})
                edge[1] += 1
                q = edge[0]
                self.reach[q] += 1
            self.end[q] += 1

    def alike(self, a: int, b: int) -> bool:
        """Whether no frequency at the two states, nor at those to which like symbols lead, differs by more than
        Hoeffding's bound."""
        todo, risk = [(a, b)], math.sqrt(0.5 * math.log(2 / ALPHA))
        while todo:
            a, b = todo.pop()
            n, m = self.reach[a], self.reach[b]
            bound = risk * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[a] / n - self.end[b] / m) > bound:
                return False
            x, y = self.go[a], self.go[b]
            for c in x.keys() | y.keys():
                if abs((x[c][1] if c in x else 0) / n - (y[c][1] if c in y else 0) / m) > bound:
                    return False
            # Of so few strings below b no frequency can differ by more than the bound, and further down they are fewer.
            todo += [(x[c][0], y[c][0]) for c in x.keys() & y.keys() if y[c][1] > risk * risk]
        return True

    def merge(self, a: int, b: int) -> None:
        """Fold the tree at b into the state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.reach[a] += self.reach[b]
            self.end[a] += self.end[b]
            for c, (to, n) in self.go[b].items():
                edge = self.go[a].get(c)
                if edge is None:
                    self.go[a][c] = [to, n]
                else:
                    edge[1] += n
                    todo.append((edge[0], to))


@dataclass
class Automaton:
    """Where a state goes and the log likelihood of doing so, by symbol; the last column is the end."""

    to: np.ndarray
    log: np.ndarray


def inferred(strings: Iterable[str]) -> Automaton:
    """The probabilistic automaton of a sample: states of the prefix tree, the most frequent first, are merged into the
    first of those kept that is alike, or kept."""
    tree = Tree(sorted(strings))
    kept, at = [0], {0: 0}
    while True:
        edges = {e[0]: (e[1], q, c) for q in kept for c, e in sorted(tree.go[q].items()) if e[0] not in at}
        if not edges:
            break
        b = max(edges, key=lambda k: (edges[k][0], -k))
        _, q, c = edges[b]
        for a in kept:
            if tree.alike(a, b):
                tree.go[q][c][0] = a
                tree.merge(a, b)
                break
        else:
            at[b] = len(kept)
            kept.append(b)
    to = np.zeros((len(kept), len(SYMBOLS) + 1), np.int64)
    log = np.zeros((len(kept), len(SYMBOLS) + 1))
    for q, state in enumerate(kept):
        total = tree.reach[state] + UNSEEN * (len(SYMBOLS) + 1)
        to[q], log[q] = q, math.log(UNSEEN / total)
        log[q, -1] = math.log((tree.end[state] + UNSEEN) / total)
        for c, (target, n) in tree.go[state].items():
            k = SYMBOLS.index(c)
            to[q, k], log[q, k] = at[target], math.log((n + UNSEEN) / total)
    return Automaton(to, log)


def likelihoods(auto: Automaton, strings: list[str]) -> np.ndarray:
    """The log likelihood of each string."""
    out = np.zeros(len(strings))
    size = np.array([len(s) for s in strings], np.int64)
    for i in np.flatnonzero(size > SHORT):
        q, total, to, log = 0, 0.0, auto.to, auto.log
        for k in CODE[np.frombuffer(strings[i].encode("latin-1"), np.uint8)].tolist():
            total += log[q, k]
            q = to[q, k]
        out[i] = total + log[q, -1]
    order = np.flatnonzero(size <= SHORT)
    order = order[np.argsort(-size[order], kind="stable")]
    data = CODE[np.frombuffer("".join(strings[i] for i in order).encode("latin-1"), np.uint8)]
    lengths = size[order]
    starts = np.cumsum(lengths) - lengths
    q, total = np.zeros(len(order), np.int64), np.zeros(len(order))
    for d in range(int(lengths[0]) if len(order) else 0):
        live = int(np.searchsorted(-lengths, -d, side="left"))
        k = data[starts[:live] + d]
        total[:live] += auto.log[q[:live], k]
        q[:live] = auto.to[q[:live], k]
    out[order] = total + auto.log[q, -1]
    return out


# --- model -------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Automata of the kinds that have one, the least likelihood a symbol and the least advantage of each, and that of
    other strings."""

    kinds: dict[str, Automaton]
    least: dict[str, float]
    ahead: dict[str, float]
    plain: Automaton | None

    def judge(self, strings: list[str]) -> list[str | None]:
        """The kind of each string that is a credential, of several the one that takes it most readily."""
        if not self.kinds or not strings:
            return [None] * len(strings)
        size = np.array([len(s) + 1 for s in strings])
        other = likelihoods(self.plain, strings)
        best, at = np.full(len(strings), -np.inf), np.full(len(strings), -1)
        for i, (kind, auto) in enumerate(self.kinds.items()):
            own = likelihoods(auto, strings)
            better = (own / size >= self.least[kind]) & (own - other >= self.ahead[kind]) & (own > best)
            best[better], at[better] = own[better], i
        names = list(self.kinds)
        return [names[i] if i >= 0 else None for i in at]


def fitted(samples: dict[str, list[str]]) -> Model:
    """Infer the automata of the samples (values by kind, others under PLAIN) and set their thresholds: all but MISSED of
    the kind's own values are likely enough, and all but TAKEN of the others do not stand out enough. A kind of fewer
    than LEAST_SAMPLE values, or whose states all merged into one, has none and so adds nothing."""
    plain = sorted(samples.get(PLAIN, []))
    model = Model({}, {}, {}, inferred(plain) if plain else None)
    for kind in KINDS:
        own = sorted(samples.get(kind, []))
        if len(own) < LEAST_SAMPLE or not plain:
            continue
        auto = inferred(own)
        if len(auto.to) < LEAST_STATES:
            continue
        scores = likelihoods(auto, own) / np.array([len(s) + 1 for s in own])
        gains = likelihoods(auto, plain) - likelihoods(model.plain, plain)
        model.kinds[kind] = auto
        model.least[kind] = float(np.quantile(scores, MISSED))
        model.ahead[kind] = MARGIN + max(0.0, float(np.quantile(gains, 1 - TAKEN)))
    return model


class _Least:
    """The distinct values of least crc32, at most ``most``."""

    def __init__(self, most: int) -> None:
        self.most, self.kept, self.bar = most, {}, 1 << 32

    def add(self, value: str) -> None:
        h = zlib.crc32(value.encode())
        if h < self.bar:
            self.kept[value] = h
            if len(self.kept) >= 2 * self.most:
                self.cut()

    def cut(self) -> dict[str, int]:
        ranked = sorted((h, v) for v, h in self.kept.items())[: self.most]
        self.kept = {v: h for h, v in ranked}
        if len(ranked) == self.most:
            self.bar = ranked[-1][0] + 1
        return self.kept


def sampled(docs: DataFrame, text: str = "text") -> dict[str, list[str]]:
    """Samples by kind: of all distinct values up to SAMPLE_LENGTH those of least crc32, so the sample does not depend
    on how rows are dealt. Each task keeps its own least ones, and they are dealt out again before the last choice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {k: _Least(SAMPLE_PLAIN if k == PLAIN else SAMPLE) for k in (*KINDS, PLAIN)}
        for batch in batches:
            for body in batch.column("x").to_pylist():
                found = marked(body)
                for _, _, kind, value in found:
                    if len(value) <= SAMPLE_LENGTH:
                        least[kind].add(value)
                others = [body[a:b] for a, b in candidates(body, found) if b - a <= SAMPLE_LENGTH]
                for value in set(others):
                    least[PLAIN].add(value)
        rows = [(k, v, h) for k, x in least.items() for v, h in x.cut().items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], ["kind", "value", "h"])

    texts = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("x"))
    found = texts.mapInArrow(run, "kind string, value string, h long").groupBy("kind", "value").agg(F.first("h").alias("h"))
    found = saved(found, "samples")
    # Up to which stretch of hashes a kind has enough values: only those are then ordered.
    most = F.when(F.col("kind") == PLAIN, SAMPLE_PLAIN).otherwise(SAMPLE)
    found = found.withColumn("stretch", F.floor(F.col("h") / (1 << 16)))
    upto = W.partitionBy("kind").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    near = found.groupBy("kind", "stretch").count().withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0))).filter(F.col("before") < most).select("kind", "stretch")
    placed = found.join(F.broadcast(near), ["kind", "stretch"]).withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy("h", "value")))
    out = placed.filter(F.col("place") <= most)
    samples: dict[str, list[str]] = {}
    for r in out.collect():
        samples.setdefault(r["kind"], []).append(r["value"])
    return samples


def fit(docs: DataFrame, text: str = "text") -> Model:
    return fitted(sampled(docs, text))


# --- scan --------------------------------------------------------------------------------------------------------

Span = tuple[int, int, str, bool]


class _Judge:
    """Remembers what was judged, up to REMEMBERED strings."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def __call__(self, texts: list[str]) -> list[list[Span]]:
        """The spans of each text, those known by their marks marked so."""
        found = [marked(t) for t in texts]
        spans = [[(a, b) for a, b in candidates(t, f)] for t, f in zip(texts, found, strict=True)] if self.model.kinds else [[] for _ in texts]
        new = list({t[a:b] for t, s in zip(texts, spans, strict=True) for a, b in s} - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list({t[a:b] for t, s in zip(texts, spans, strict=True) for a, b in s})
        self.known.update(zip(new, self.model.judge(new), strict=True))
        out = []
        for t, f, s in zip(texts, found, spans, strict=True):
            more = [(a, b, kind, False) for a, b in s if (kind := self.known[t[a:b]])]
            out.append(sorted([(a, b, k, True) for a, b, k, _ in f] + more, key=lambda x: (x[0], KINDS.index(x[2]))))
        return out


PLACE = StructType().add("start", "long").add("end", "long").add("kind", "string").add("by_mark", "boolean")
#: Characters of texts that are judged at once.
AT_ONCE = 1 << 20


def secrets(docs: DataFrame, model: Model, text: str = "text", out: str = "secrets") -> DataFrame:
    """Each row of ``docs`` with its credentials: an array of (start, end, kind, by_mark), in code points, ends
    exclusive, by start, then kind as listed. Null and empty texts have none; texts are read whole, whatever their
    length; equal rows are judged alike; a column named as the result is replaced."""
    kind = docs.select(*[c for c in docs.columns if c.lower() != out.lower()])
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("by_mark", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(model)
        for batch in batches:
            bodies = [x or "" for x in batch.column(text).to_pylist()]
            found: list[list[Span]] = []
            at = 0
            while at < len(bodies):
                end, size = at, 0
                while end < len(bodies) and (end == at or size + len(bodies[end]) <= AT_ONCE):
                    size += len(bodies[end])
                    end += 1
                found += judge(bodies[at:end])
                at = end
            flat = [{"start": a, "end": b, "kind": k, "by_mark": m} for s in found for a, b, k, m in s]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, place))], [*batch.schema.names, out])

    return kind.mapInArrow(run, StructType([*kind.schema.fields, StructField(out, ArrayType(PLACE))]))


def masked(docs: DataFrame, model: Model, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every credential in the text replaced; overlapping ones are replaced as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(model)
        for batch in batches:
            made = []
            for body in batch.column(text).to_pylist():
                parts, at = deque(), 0
                for a, b, _, _ in judge([body])[0] if body else ():
                    if a >= at:
                        parts += [body[at:a], mark]
                    at = max(at, b)
                made.append("".join(parts) + body[at:] if parts else body)
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, batch.schema.field(i), pa.array(made, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = secrets(docs, fit(docs))
    base = F.filter("secrets", lambda s: s["by_mark"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["by_mark"] & (s["kind"] == kind))).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
