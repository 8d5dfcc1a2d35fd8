"""Spelling variants: words one edit from a much more frequent one.

The vocabulary is cut, in order, into tries of bounded size. They are broadcast by groups of bounded size; each word's
distance-one Levenshtein automaton is walked through every trie depth-first. What a word finds is reduced in the task,
then over groups.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, table

#: Code points and occurrences that a word has at least.
LEAST_LENGTH = 6
LEAST_TIMES = 5
#: How many times more frequent a form is than its variant.
TIMES = 5
#: One in so many pairs of document and word loses a code point in the query.
ONE_IN = 199
#: Code points of one trie, of which each takes 13 bytes at most; a single longer word is a trie of its own.
TRIE_CODES = 2_000_000
#: Bytes of tries that are broadcast at once.
GROUP_BYTES = 32 << 20
#: Distinct words that a task counts before it hands them on, and code points of a text that are searched at once.
MOST_COUNTED = 300_000
SLICE = 1 << 20
#: Doublings within which a chain of forms ends: counts grow by TIMES a step.
DOUBLINGS = 6

LETTERS = rb"[a-z\xc0-\xff]"


# --- counting ----------------------------------------------------------------------------------------------------


def _runs(text: str, least: int) -> Iterator[list[bytes]]:
    """Maximal runs of at least ``least`` letters, A-Z lower-cased, as Latin-1 bytes; by slices that end between runs."""
    data = text.encode("latin-1", "replace").lower()
    find, gap = re.compile(LETTERS + b"{%d,}" % least).findall, re.compile(rb"[^a-z\xc0-\xff]")
    at = 0
    while at < len(data):
        cut = gap.search(data, at + SLICE)
        end = cut.start() if cut else len(data)
        yield find(data, at, end)
        at = end


def without_one(word: bytes, h: int) -> bytes:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, one_in: int = 0) -> DataFrame:
    """Rows (word, n) of the letter runs of all whole texts, A-Z lower-cased, that have ``least`` code points.

    With ``one_in``, a word of a document loses a code point where that number divides the crc32 of '<key>:<word>'.
    Null texts have none; a null key counts as an empty one; equal rows count each. Tasks count before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words, n = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for name, body in zip(batch.column("k").to_pylist(), batch.column("x").to_pylist(), strict=True):
                start = zlib.crc32(f"{name}:".encode("utf-8", "surrogatepass"))
                for runs in _runs(body, least):
                    for word, n in Counter(runs).items():
                        if one_in:
                            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                            if h % one_in == 0:
                                word = without_one(word, h)
                                if len(word) < least:
                                    continue
                        counts[word] += n
                if len(counts) > MOST_COUNTED:
                    yield out()
        yield out()

    rows = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("x"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- tries -------------------------------------------------------------------------------------------------------


class Trie(NamedTuple):
    """Nodes in breadth-first order, so that a node's children lie side by side: the last letter of each, the first
    child of each (the next node's is their end), and how often the word that ends there occurs (0: none ends)."""

    letters: bytes
    first: bytes
    times: bytes

    def opened(self) -> tuple[bytes, memoryview, memoryview]:
        return self.letters, memoryview(self.first).cast("i"), memoryview(self.times).cast("q")


def built(words: list[bytes], times: list[int]) -> Trie:
    """The trie of distinct words in byte order."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    n = np.array(times, np.int64)
    letters, sizes, counts = [np.zeros(1, np.uint8)], [], [np.zeros(1, np.int64)]
    live, parent, depth, parents = np.arange(len(words)), np.zeros(len(words), np.int64), 0, 1
    while len(live):
        c = data[starts[live] + depth]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (parent[1:] != parent[:-1])))
        node, head = np.cumsum(new) - 1, np.flatnonzero(new)
        letters.append(c[head])
        sizes.append(np.bincount(parent[head], minlength=parents))
        own, last = np.zeros(len(head), np.int64), starts[live] + depth + 1 == ends[live]
        own[node[last]] = n[live[last]]
        counts.append(own)
        live, parent, depth, parents = live[~last], node[~last], depth + 1, len(head)
    sizes.append(np.zeros(parents, np.int64))
    first = np.concatenate(([1], 1 + np.cumsum(np.concatenate(sizes)))).astype(np.int32)
    return Trie(np.concatenate(letters).tobytes(), first.tobytes(), np.concatenate(counts).tobytes())


def near(word: bytes, trie: tuple[bytes, memoryview, memoryview]) -> Iterator[tuple[int, bytes]]:
    """Each word of the trie at edit distance one, with its count.

    The automaton's states are (d, no edit), which subsumes what one edit makes of it, and sets of (p, one edit). A
    letter other than the next leads from (d, no edit) to (d, one edit) by insertion, to (d + 1, one edit) by
    replacement and, if it is the letter after the next, to (d + 2, one edit) by deletion. From (p, one edit) only
    the rest of the word is spelt; rests differ in length, so no word is met twice.
    """
    letters, first, times = trie
    end, find = len(word), letters.find
    node, d = 0, 0
    while True:
        low, high = first[node], first[node + 1]
        here, after = word[d] if d < end else -1, word[d + 1] if d + 1 < end else -1
        ahead = -1
        for child in range(low, high):
            c = letters[child]
            if c == here:
                ahead = child
                continue
            for p in (d, d + 1, d + 2) if c == after else (d, d + 1):
                at = child
                for x in word[p:] if p <= end else b"\0":
                    at = find(x, first[at], first[at + 1])
                    if at < 0:
                        break
                else:
                    if times[at]:
                        yield times[at], word[:d] + letters[child : child + 1] + word[p:]
        if d == end - 1 and times[node]:
            yield times[node], word[:d]
        if ahead < 0:
            return
        node, d = ahead, d + 1


def tries(words: DataFrame, codes: int = TRIE_CODES) -> DataFrame:
    """Rows (letters, first, times) of tries that hold all rows (word, n): ranges of words in order, cut anew where one
    has more code points than ``codes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: list[bytes] = []
        times: list[int] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in built(listed, times)._asdict().items()})

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                coded = word.encode("latin-1")
                if listed and size + len(coded) > codes:
                    yield out()
                    listed, times, size = [], [], 0
                listed.append(coded)
                times.append(n)
                size += len(coded)
        if listed:
            yield out()

    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    dealt = words.repartitionByRange(max(1, -(-total // codes)), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "letters binary, first binary, times binary")


# --- variants ----------------------------------------------------------------------------------------------------


def _found(words: DataFrame, group: list[Trie]) -> DataFrame:
    """Of each word (word, n, n_near, best_n, best): how many words of the group are near, the most frequent of them
    and, of equals, the first in order."""
    sent = words.sparkSession.sparkContext.broadcast([tuple(t) for t in group])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [Trie(*t).opened() for t in sent.value]
        for batch in batches:
            many, best_n, best = [], [], []
            for word in batch.column("word").to_pylist():
                coded, seen, top, form = word.encode("latin-1"), 0, 0, None
                for trie in opened:
                    for n, other in near(coded, trie):
                        seen += 1
                        if n > top or n == top and other < form:
                            top, form = n, other
                many.append(seen)
                best_n.append(top or None)
                best.append(form and form.decode("latin-1"))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(many, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())], ["word", "n", "n_near", "best_n", "best"])

    return words.mapInArrow(run, "word string, n long, n_near long, best_n long, best string")


def _groups(spark: SparkSession, shards: DataFrame, most: int) -> Iterator[list[Trie]]:
    """The tries by groups of ``most`` bytes or one trie. Only sizes are listed for all; of a group the tries come."""
    sizes = shards.select("shard", (F.length("letters") + F.length("first") + F.length("times")).alias("size")).orderBy("shard").collect()
    group: list[int] = []
    used = 0
    for shard, size in [(r["shard"], r["size"]) for r in sizes] + [(None, 0)]:
        if group and (shard is None or used + size > most):
            yield [Trie(bytes(r["letters"]), bytes(r["first"]), bytes(r["times"])) for r in shards.filter(F.col("shard").isin(group)).collect()]
            group, used = [], 0
        group.append(shard)
        used += size


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): the last form of each chain, by doubling. Counts grow along a chain, so it
    has no circle and ends."""
    now = saved(links.select("word", F.col("form").alias("root")), "chains")
    for _ in range(DOUBLINGS):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = saved(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chains")
        now = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return now
    raise RuntimeError(f"a chain of forms is longer than 2 ** {DOUBLINGS}")


def variants(words: DataFrame, times: int = TIMES, codes: int = TRIE_CODES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of distinct words (word, n) of Latin-1 letters.

    n_near counts the words at edit distance one in code points. The form is the most frequent of them (of equals the
    first in code-point order) if it occurs ``times`` as often; root follows forms to the last, and is the word itself
    without any. No words give no rows. A word may be of any length.
    """
    spark = words.sparkSession
    words = saved(words.select("word", "n"), "words")
    shards = saved(tries(words, codes), "tries")
    # Tries differ, so their hashes tell them apart; equal hashes would only bring two into one group.
    shards = shards.withColumn("shard", F.xxhash64("letters", "first", "times"))
    parts = None
    for group in _groups(spark, shards, group_bytes):
        made = saved(_found(words, group), "near")
        parts = made if parts is None else parts.unionByName(made)
    if parts is None:
        parts = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("order"), "best"))).alias("top")
    whole = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    is_form: Column = -F.col("top.order") >= F.col("n") * times
    told = saved(whole.select("word", "n", "n_near", F.when(is_form, F.col("top.best")).alias("form"), F.when(is_form, -F.col("top.order")).alias("form_n")), "forms")
    ends = roots(told.filter("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, one_in: int = 0, **how) -> DataFrame:
    """variants() of the words of all texts that have ``least`` code points and occur ``least_times``."""
    return variants(word_counts(docs, key, text, least, one_in).filter(F.col("n") >= least_times), **how)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(docs, one_in=ONE_IN)


#: crc32 by its table, which a fold over eight bits makes.
CRC_SQL = "crc AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS steps FROM (SELECT unnest(range(256)) AS b))"


def crc_sql(codes: str) -> str:
    """crc32 of a list of byte values, where ``crc`` is joined."""
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_BYTES = "flatten(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN unicode(s[i]) < 128 THEN [unicode(s[i])::BIGINT] ELSE [192 + (unicode(s[i]) >> 6)::BIGINT, 128 + (unicode(s[i]) & 63)::BIGINT] END))"
OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql(_BYTES)} AS h FROM (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM pairs), crc),
cut AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_TIMES}),
holes AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (
  SELECT DISTINCT word, n, other, other_n FROM (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, (list({{'o': -other_n, 'w': other}} ORDER BY -other_n, other))[1] AS top FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.o >= {TIMES} * n THEN top.w END AS form, CASE WHEN -top.o >= {TIMES} * n THEN -top.o END AS form_n FROM words LEFT JOIN best USING (word)),
chain(word, root, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
