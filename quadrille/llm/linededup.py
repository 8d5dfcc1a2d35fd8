"""Line dedup: an exact set-similarity join of lines that removes the later matches, in SQL expressions alone.

A line's tokens are its distinct word shingles. They are listed rare first, so that two similar lines share a token
of their lists; those whose lists have too few tokens in common are not compared. Lines that share a token with many
meet the earliest of these first, and only those that match it nowhere meet the rest of them.

prefixes() lists tokens by numpy on Arrow batches, for callers whose executors have room for Python workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .setjoin import PERCENT, WORDS, overlap, passes
from .shared import saved, sized, table
from .textkernel import SHINGLED_BYTES, SPACES, U, Words, grams, sequence_keys, slices, words

#: Cells of the table of token counts that says how rare a token is; it decides cost, never results.
CELLS = 1 << 16
#: Bits of a token below its rank.
HASH_BITS = 48
#: Lines in a bucket up to which all of them may meet; it decides cost, never results.
BUSY = 64
#: Rows of keys and line numbers, and lines to go, that may be broadcast.
FEW = 200_000
MANY = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of all texts, and of each the number of its text and its own in it."""
    listed = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
    return listed.flatten(), np.repeat(np.arange(len(texts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _tokens(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of lines of ``size`` words and more, and the number of the line of each."""
    g = grams(w.hashes(), size)
    line = np.repeat(np.arange(len(w.of) - 1), np.diff(w.of))[: len(g)]
    whole = np.arange(len(g)) + size <= w.of[1:][line]
    return g[whole], line[whole]


def _ordered(key: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each line in order, line after line, and how many each line has."""
    at = np.lexsort((key, line))
    key, line = key[at], line[at]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (line[1:] != line[:-1]))) if len(key) else np.zeros(0, bool)
    return key[new], np.bincount(line[new], minlength=lines)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _listed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), _long(values))


def read(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k (the key, null least of all), t (which of several texts of one key) and x, the text."""
    return docs.select(_key(key).alias("k"), _text_key(text).alias("t"), F.coalesce(text, F.lit("")).alias("x"))


def ranks(docs: DataFrame, size: int = WORDS) -> np.ndarray:
    """How often each cell of tokens occurs in all lines: CELLS ranks of 16 bits, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for _, texts in slices(batches, "x", SHINGLED_BYTES):
            g, _ = _tokens(words(_lines(texts)[0], SPACES), size)
            counts += np.bincount((g >> U(HASH_BITS)).astype(np.int64), minlength=CELLS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["cell", "n"])

    made = docs.select("x").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[made["cell"]] = made["n"]
    # Only the order of the counts matters.
    return np.minimum(np.unique(counts, return_inverse=True)[1], 0x7FFE).astype(U)


def prefixes(docs: DataFrame, rank: np.ndarray, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (k, t, line_no, c, c2, n, tokens) of the lines with words: two keys of the words, the number of tokens and
    the first of them, the rarest first: a token's rank above HASH_BITS bits of its hash. Lines of fewer words are one
    token by themselves, which only an equal line could share, so it is not listed."""
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "x", SHINGLED_BYTES):
            lines, text_of, number = _lines(texts)
            w = words(lines, SPACES)
            g, line = _tokens(w, size)
            place = sent.value[(g >> U(HASH_BITS)).astype(np.int64)] << U(HASH_BITS) | g & U((1 << HASH_BITS) - 1)
            place, n = _ordered(place, line, len(lines))
            first = np.cumsum(n) - n
            length = n - (n * percent + 99) // 100 + (n > 0)
            pos = np.arange(len(place)) - np.repeat(first, n)
            kept = place[pos < np.repeat(length, n)]
            c, c2 = sequence_keys(w)
            at = pa.array(text_of)
            made = pa.RecordBatch.from_arrays([part.column("k").take(at), part.column("t").take(at), pa.array(number.astype(np.int32)), _long(c), _long(c2), pa.array(np.maximum(n, 1).astype(np.int32)), _listed(kept, length)], names)
            yield made.filter(pa.array(np.diff(w.of) > 0))

    names = ["k", "t", "line_no", "c", "c2", "n", "tokens"]
    return docs.mapInArrow(run, "k long, t long, line_no int, c long, c2 long, n int, tokens array<bigint>")


def lines_of(docs: DataFrame) -> DataFrame:
    """A row for each line of read() rows: k, t, line_no and the line as x."""
    return docs.select("k", "t", F.posexplode(F.split("x", "\n")).alias("line_no", "x"))


def words_of(line: Column) -> Column:
    """Runs of other than white space, with A-Z folded. Blanks part words; other white space, rare, becomes blanks.
    ASCII lines, in which lower() folds nothing but A-Z, take it; the others the slower translate()."""
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\f")) | F.contains(line, F.lit("\x0b"))
    plain = ~odd & (F.length(line) == F.octet_length(line))
    folded = F.when(plain, F.lower(line)).otherwise(F.translate(line, f"{UPPER}\t\r\f\x0b", f"{LOWER}    "))
    return F.array_remove(F.split(folded, " "), "")


def shingled(lines: DataFrame, size: int = WORDS) -> DataFrame:
    """Lines with, in place of x, two keys c and c2 of their words, the number n of their shingles (no words: 0) and the
    distinct hashes s of those of ``size`` words. A line of fewer words is one shingle by itself, which only an equal line
    could share, so it is not listed. Words are hashed first: numbers are cheaper to combine."""
    made = lines.withColumn("w", words_of(F.col("x")))
    made = made.withColumn("x", F.transform("w", lambda x: F.xxhash64(x)))
    begins = F.slice("x", F.lit(1), F.greatest(F.size("x") - (size - 1), F.lit(0)))
    many = F.transform(begins, lambda x, i: F.xxhash64(x, *[F.get("x", i + j) for j in range(1, size)]))
    made = made.select(*[c for c in lines.columns if c != "x"], F.xxhash64("w").alias("c"), F.xxhash64(F.lit(1), "w").alias("c2"), F.least(F.size("w"), F.lit(1)).alias("some"), F.array_distinct(many).alias("s"))
    return made.withColumn("n", F.greatest(F.size("s"), F.col("some"))).drop("some")


def counts_of(texts: DataFrame, size: int = WORDS) -> Column:
    """What stands above HASH_BITS bits of a token of each cell, as a constant array: CELLS numbers, whatever the corpus,
    by how often the tokens of a cell occur in all texts. Shingles across two lines are counted too, letters other than
    A-Z folded and rare white space left, which is faster and only moves counts."""
    # Words beside those that follow them, as columns: so every step is compiled. One-token lines need no order.
    w, names = F.col("w"), [f"w{j}" for j in range(size)]
    beside = F.arrays_zip(*[F.slice(w, F.lit(j + 1), F.greatest(F.size(w) - (size - 1), F.lit(0))) for j in range(size)])
    rows = texts.select(F.split(F.lower(F.replace("x", F.lit("\n"), F.lit(" "))), " ").alias("w")).select(F.inline(beside)).toDF(*names)
    cells = rows.select(_cell(F.xxhash64(*[F.xxhash64(n) for n in names])).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["cell"]: r["n"] for r in cells.collect()}
    # Only the order of the counts matters; one literal instead of CELLS.
    place = {n: min(i, 0x7FFE) << HASH_BITS for i, n in enumerate(sorted({0, *counts.values()}))}
    return F.split(F.lit(",".join(str(place[counts.get(c, 0)]) for c in range(CELLS))), ",").cast("array<bigint>")


def _cell(h: Column) -> Column:
    return F.shiftrightunsigned(h, HASH_BITS).cast("int")


def length(n: Column, percent: int = PERCENT) -> Column:
    """How many of n tokens, in an order that all sets share, are enough to meet each similar set by one of them."""
    return n - F.ceil(n * percent / F.lit(100.0) - F.lit(1e-9)).cast("int") + 1


def indexed(lines: DataFrame, counts: Column, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (k, t, line_no, c, c2, n, tokens) of all lines, with the rarest of their tokens: their place by counts_of()
    above HASH_BITS bits of their hash. Save them before you filter: a filter would be pushed below the arrays and work
    them out twice."""
    placed = F.transform("s", lambda h: F.get(counts, _cell(h)).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1))))
    return shingled(lines, size).select("k", "t", "line_no", "c", "c2", "n", F.slice(F.sort_array(placed), F.lit(1), length(F.col("n"), percent)).alias("tokens"))


def entries_of(contents: DataFrame) -> DataFrame:
    """Rows (h, c, n, pos) of the listed tokens that another content lists too. Both sides of the join have the same
    columns in use, so they are one shuffle; a large bucket may be split, as a row looks for one other alone."""
    index = contents.select("c", "n", F.posexplode("tokens").alias("pos", "h"))
    other = (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.n") + F.col("y.n") + F.col("y.pos") > 0)
    return index.alias("x").join(index.alias("y").hint("merge"), other, "left_semi").select("x.h", "x.c", "x.n", "x.pos")


def met(x: DataFrame, y: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs (c, b) of contents of the entries x and earlier ones of the entries y that share a token."""
    x, y = x.alias("x"), y.alias("y")
    meet = (F.col("x.h") == F.col("y.h")) & (F.col("y.f") < F.col("x.f"))
    pairs = x.join(y, meet & passes(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent))
    return pairs.select(F.col("x.c").alias("c"), F.col("y.c").alias("b")).distinct()


def enough(x: str, y: str, percent: int = PERCENT) -> Column:
    """How many tokens the lists of similar sets with x and y tokens have in common at least. Of the two lists, that which
    ends first has length(n) tokens, which the other lists too if it has them; but n less the least overlap may differ."""
    n, m = F.col(x), F.col(y)
    most = F.greatest(n, m)
    return overlap(n, m, percent) + length(most, percent) - most


def counted(entries: DataFrame, crowded: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (c, b) of contents and earlier ones whose lists have enough tokens in common; ``entries`` lacks ``more`` of
    those of ``crowded``."""
    x, y = entries.alias("x"), entries.alias("y")
    meet = (F.col("x.h") == F.col("y.h")) & (F.col("y.f") < F.col("x.f")) & (F.least("x.seen", "y.seen") >= enough("x.n", "y.n", percent))
    pairs = x.join(y, meet & passes(F.col("x.n"), F.lit(0), F.col("y.n"), F.lit(0), percent))
    pairs = pairs.groupBy(F.col("x.c").alias("c"), F.col("y.c").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(F.count(F.lit(1)).alias("common"), F.max("x.pos").alias("i"), F.max("y.pos").alias("j"))
    crowded = sized(crowded, FEW)
    pairs = pairs.join(crowded.withColumnRenamed("more", "more_c"), "c", "left").join(crowded.select(F.col("c").alias("b"), F.col("more").alias("more_b")), "b", "left")
    more = F.least(F.coalesce("more_c", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    common, least = F.col("common") + more, overlap(F.col("n"), F.col("m"), percent)
    # Up to their last common token, neither list has more others than its whole set may have.
    few = (F.col("i") + 1 - common <= F.col("n") - least) & (F.col("j") + 1 - common <= F.col("m") - least)
    return pairs.filter(few & (common >= enough("n", "m", percent))).select("c", "b")


def rare_first(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Entries (h, c, n, pos, f) of whole sets (c, f, s), by the order of how many of them have a token."""
    rows = sets.select("c", F.explode("s").alias("h"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    listed = rows.join(counts, "h").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("times", "h"))).alias("s"))
    listed = listed.select("c", F.size("s").alias("n"), F.slice("s.h", F.lit(1), length(F.size("s"), percent)).alias("tokens"))
    return listed.join(sets.select("c", "f"), "c").select("c", "n", "f", F.posexplode("tokens").alias("pos", "h"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (c, b) of contents those that are similar, as (c, c2) of the first; judged by all their shingles."""
    both = pairs.join(sets.select("c", "c2", "s"), "c").join(sets.select(F.col("c").alias("b"), F.col("s").alias("z")), "b")
    common, total = F.size(F.array_intersect("s", "z")), F.size("s") + F.size("z")
    return both.withColumn("common", common).filter(F.col("common") * 100 >= (total - F.col("common")) * percent).select("c", "c2").distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The lines that go, as rows (k, t, line_no): those similar to an earlier line, by (key, text, place in the text).

    Lines are what line feeds part; blank ones stay. Two lines are similar when 100 * intersection >= percent * union
    of their distinct shingles; under ``words_per`` words the whole line is the one shingle. A line goes if any
    earlier one is similar, whether that one goes or stays. Equal rows are one row: none of them is earlier.

    Each text is shingled twice, for the counts and for the index, and lines that share tokens are again. Equal lines, told apart
    from others by two keys of 64 bits, are one content with the place of its first line, however many they are.
    """
    texts = read(docs, key, text)
    lines = lines_of(texts)
    index = saved(indexed(lines, counts_of(texts, words_per), words_per, percent), "index").filter("n > 0")
    place = F.struct("k", "t", "line_no")
    first = F.min(F.struct("k", "t", "line_no", "n", "tokens")).alias("first")
    contents = index.groupBy("c", "c2").agg(first, F.count(F.lit(1)).alias("times"))
    contents = saved(contents.select("c", "c2", "times", F.struct("first.k", "first.t", "first.line_no").alias("f"), "first.n", "first.tokens"), "contents")
    entries = entries_of(contents).join(contents.select("c", "f"), "c")
    entries = saved(entries.withColumn("seen", F.count(F.lit(1)).over(W.partitionBy("c"))), "entries")
    entries = saved(entries.join(entries.groupBy("h").agg(F.count(F.lit(1)).alias("many")), "h"), "buckets")

    # All of a bucket of bounded size meet. In a larger one, everything meets the earliest.
    small, large = entries.filter(F.col("many") <= BUSY), entries.filter(F.col("many") > BUSY)
    crowded = saved(large.groupBy("c").agg(F.count(F.lit(1)).alias("more")), "crowded")
    hubs = large.groupBy("h").agg(F.min(F.struct("f", "c", "n", "pos", "seen")).alias("hub"))
    first = large.join(hubs, "h").filter(F.col("c") != F.col("hub.c")).filter(F.least("seen", "hub.seen") >= enough("n", "hub.n", percent)).filter(passes(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent))
    pairs = saved(counted(small, crowded, percent).union(first.select("c", F.col("hub.c").alias("b"))).distinct(), "pairs")

    # All shingles of what is or may be compared, from the first line of each content.
    ends = pairs.select("c").union(pairs.select("b")).union(crowded.select("c")).distinct()
    wanted = saved(contents.join(ends, "c", "left_semi").select("f.*").distinct(), "wanted")
    sets = shingled(lines.join(sized(wanted, FEW), ["k", "t", "line_no"]), words_per)
    sets = saved(sets.select("c", "c2", "s", place.alias("f")), "sets")
    gone = saved(verified(pairs, sets, percent), "gone")

    # What shares tokens of larger buckets, and matched nothing yet, meets the others that do by the rarest of all tokens.
    if not crowded.join(gone, "c", "left_anti").isEmpty():
        listed = saved(rare_first(sets.join(crowded, "c", "left_semi"), percent), "rare")
        rest = saved(met(listed.join(gone, "c", "left_anti"), listed, percent).join(pairs, ["c", "b"], "left_anti"), "rest")
        gone = gone.union(verified(rest, sets, percent)).distinct()

    # Contents that go with all their lines, and those that go with all but the first.
    again = contents.filter("times > 1").select("c", "c2", "f")
    judged = saved(again.union(gone.select("c", "c2", F.lit(None).cast(contents.schema["f"].dataType))), "judged")
    later = index.select("c", "c2", "k", "t", "line_no").join(sized(judged, FEW), ["c", "c2"]).filter(F.col("f").isNull() | (place != F.col("f")))
    return later.select("k", "t", "line_no").distinct()


def gone_lines(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    """Rows (k, t, gone): the sorted numbers of the lines that go from a text, broadcast if their count is bounded."""
    lines = saved(repeated_lines(docs, key, text, **how), "lines_gone")
    gone = lines.groupBy("k", "t").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    return F.broadcast(gone) if lines.limit(MANY + 1).count() <= MANY else gone


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with the text less its repeated lines (see repeated_lines); other columns are as they were.

    Rows whose lines all go stay, with an empty text; null texts stay null; null keys are the least; an empty table
    stays empty; a line may be of any length.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), _key(key).alias("k"), _text_key(text).alias("t"))
    rows = rows.join(gone_lines(docs, key, text, **how), ["k", "t"], "left")
    left = F.filter(F.split(f"row.{text}", "\n"), lambda _, i: ~F.array_contains(F.col("gone"), i))
    new = F.when(F.col("gone").isNull(), F.col(f"row.{text}")).otherwise(F.array_join(left, "\n"))
    return rows.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, and the numbers of the removed lines as a list in a string."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    rows = docs.select("doc_id", n_lines.alias("n_lines"), _key("doc_id").alias("k"), _text_key("text").alias("t"))
    rows = rows.join(gone_lines(docs, "doc_id", "text"), ["k", "t"], "left")
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))


OP6_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
worded AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(translate(line, '{UPPER}', '{LOWER}'), '[ \\t\\r\\f\\x0B]+'), lambda w: w <> '') AS w FROM lines),
placed AS (SELECT doc_id, line_no, w, row_number() OVER (ORDER BY doc_id, line_no) AS f FROM worded WHERE len(w) > 0),
contents AS (SELECT w, min(f) AS c FROM placed GROUP BY w),
sets AS (
  SELECT c, list_distinct(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ')) END) AS s FROM contents),
tokens AS (SELECT c, len(s) AS n, unnest(s) AS h FROM sets),
pairs AS (
  SELECT x.c, y.c AS b, count(*) AS common, x.n + y.n - count(*) AS total FROM tokens x JOIN tokens y ON x.h = y.h AND y.c < x.c AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {PERCENT}
  GROUP BY x.c, y.c, x.n, y.n),
gone AS (SELECT DISTINCT c FROM pairs WHERE common * 100 >= total * {PERCENT}),
removed AS (
  SELECT doc_id, line_no FROM placed JOIN contents USING (w) WHERE f > c OR c IN (SELECT c FROM gone)),
listed AS (SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed FROM removed GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10))) AS n_lines, coalesce(l.n, 0) AS n_removed, coalesce(l.removed, '') AS removed
FROM documents d LEFT JOIN listed l USING (doc_id)
"""
