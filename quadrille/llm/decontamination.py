"""Benchmark decontamination: find benchmark items in documents up to a share of edited words.

Windows of an item's size are embedded by CGK random walks, which turn edit distance into Hamming distance, and
looked up by repeated bit sampling; what is found is verified by the exact word edit distance. Before that, windows
that hold too few word pairs of the items of their size are passed over. That loses nothing: each edit breaks two
pairs at most, so within k edits of an item of n words a window has n - 1 - 2k of its pairs or more. Items too short
for an edit are looked up by the hash of all their words. In scripts without blanks each character is a word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table
from .textkernel import NOT_ALNUM, SHINGLED_BYTES, U, Words, coded, grams, mix, slices, table_of, words

#: Share of an item's words that may be inserted, deleted or replaced.
EDITS = 0.2
#: Shorter items are searched without edits, of which they may have none; longer ones in parts of at most MAX_WORDS.
MIN_WORDS = 5
MAX_WORDS = 128
#: Items, and MB of their texts, whose index is sent to the tasks at once; more are searched in further passes.
BLOCK_ITEMS = 4_000
BLOCK_BYTES = 2 << 20
#: Windows that are embedded at once.
WINDOWS = 20_000
#: Positions sampled for one key, keys taken of one walk, and the recall that sets the number of walks.
SAMPLED = 2
KEYS_PER_WALK = 8
RECALL = 0.995
#: Walks that are simulated, and if they are too few, simulated next; beyond them there is an error.
MAX_WALKS = (32, 160)


@dataclass
class Size:
    """The items of one number of words."""

    length: int
    limit: int
    codes: np.ndarray
    ids: list


@dataclass
class Index:
    vocabulary: np.ndarray  # sorted word hashes; code 0 stands for all others
    coarse: np.ndarray  # by the top bits of a hash, whether any word has them
    pairs: np.ndarray  # the same for pairs of neighbouring words
    coarse_pairs: np.ndarray
    member: np.ndarray  # whether a pair's code is in items of a size
    sizes: list[Size]
    keys: np.ndarray  # sorted; each of the item of that number in that size
    key_size: np.ndarray
    key_item: np.ndarray
    walks: int
    short: dict[int, tuple[np.ndarray, np.ndarray, list[list]]]  # by words: sorted hashes of whole items, their table, and ids


def read(texts: pa.Array) -> Words:
    return words(pc.utf8_lower(texts), NOT_ALNUM, apart=True)


def walk(codes: np.ndarray, lengths: np.ndarray, number: int, steps: int) -> np.ndarray:
    """CGK embedding of rows of codes, which are followed by padding: at each step the symbol under the cursor is
    written, and a random bit of step and symbol moves the cursor on or not, until it stands behind the row."""
    out = np.empty((len(codes), steps), U)
    at, each = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for j in range(steps):
        symbol = (codes[each, at] + 1).astype(U)
        out[:, j] = symbol
        bit = mix(symbol * U(0x9E3779B97F4A7C15) + U(j * 1009 + number * 7919 + 1)) >> U(63)
        at = np.minimum(at + bit.astype(np.int64), lengths)
    return out


def keys(codes: np.ndarray, lengths: np.ndarray, walks: int) -> np.ndarray:
    """LSH keys of rows of codes: KEYS_PER_WALK samples of SAMPLED positions of each walk; which ones, the row's
    item size decides, and it is part of the key."""
    out = np.empty((len(codes), walks * KEYS_PER_WALK), U)
    each = np.arange(len(codes))
    sizes, kind = np.unique(lengths, return_inverse=True)
    for r in range(walks):
        embedded = walk(codes, lengths, r, 2 * int(sizes.max(initial=1)))
        drawn = np.array([np.random.Generator(np.random.PCG64([int(n), r])).integers(0, 2 * int(n), (KEYS_PER_WALK, SAMPLED)) for n in sizes], np.int64).reshape(-1, KEYS_PER_WALK, SAMPLED)
        for b in range(KEYS_PER_WALK):
            key = lengths.astype(U) * U(1 << 20) + U(r * KEYS_PER_WALK + b + 1)
            for k in range(SAMPLED):
                key = mix(key * U(0xD6E8FEB86659FD93) + embedded[each, drawn[kind, b, k]])
            out[:, r * KEYS_PER_WALK + b] = key
    return out


def edited(code: np.ndarray, edits: int, fresh_code: int, rng: np.random.Generator) -> np.ndarray:
    out = list(code)
    for _ in range(edits):
        p, kind = int(rng.integers(len(out))), int(rng.integers(3))
        if kind == 0:
            out[p] = fresh_code
        elif kind == 1:
            out.insert(p, fresh_code)
        elif len(out) > 1:
            del out[p]
    return np.array(out, np.int64)


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full((len(rows), width + 1), -1, np.int64)
    for i, r in enumerate(rows):
        out[i, : min(width, len(r))] = r[:width]
    return out


def walks_for(groups: dict[int, list[np.ndarray]], edits: float, recall: float) -> int:
    """Walks after which items with as many random edits as allowed are found with the wanted recall. They are
    counted on simulated edits of a few items, as agreement after an edit depends on the words; where no number up to
    the last of MAX_WALKS is enough, that is an error."""
    for most in MAX_WALKS:
        rng = np.random.Generator(np.random.PCG64(11))
        hit = np.zeros((0, most), bool)
        for length in sorted(groups)[:: max(1, len(groups) // 8)]:
            own = groups[length][:8]
            pairs = [(c, edited(c, int(length * edits), 0, rng)) for c in own for _ in range(6)]
            a, b = (keys(padded([p[k] for p in pairs], length), np.full(len(pairs), length), most) for k in (0, 1))
            hit = np.concatenate((hit, (a == b).reshape(len(pairs), most, -1).any(axis=2)))
        found = np.logical_or.accumulate(hit, axis=1).mean(axis=0)
        enough = np.flatnonzero(found >= recall)
        if len(enough):
            return int(enough[0]) + 1
    raise ValueError(f"{MAX_WALKS[-1]} walks find {found[-1]:.3f} of items with a share of {edits} edited words; {recall} are wanted")


def index(items: list[tuple], edits: float = EDITS, recall: float = RECALL) -> Index:
    """Index (id, text) pairs. Null and wordless texts are left out; of parts of one item, each is searched."""
    held = [(i, t) for i, t in items if t]
    w = read(pa.array([t for _, t in held], pa.string()))
    h = w.hashes()
    vocabulary = np.unique(h)
    coarse = table_of(vocabulary)
    codes = coded(vocabulary, coarse, h).astype(np.int64)
    pair_hashes = np.append(grams(h, 2), U(0))[: len(h)]
    pairs = np.unique(pair_hashes)
    coarse_pairs = table_of(pairs)
    pair_codes = coded(pairs, coarse_pairs, pair_hashes)
    groups: dict[int, list[np.ndarray]] = defaultdict(list)
    own_pairs: dict[int, list[np.ndarray]] = defaultdict(list)
    ids: dict[int, list] = defaultdict(list)
    brief: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for k, (i, _) in enumerate(held):
        bounds = np.linspace(w.of[k], w.of[k + 1], max(1, -(-int(w.of[k + 1] - w.of[k]) // MAX_WORDS)) + 1).astype(int)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= MIN_WORDS:
                groups[b - a].append(codes[a:b])
                own_pairs[b - a].append(pair_codes[a : b - 1])
                ids[b - a].append(i)
            elif b > a:
                if int((b - a) * edits):
                    raise ValueError(f"items under {MIN_WORDS} words are searched without edits; with {edits} one of {b - a} words may have some")
                brief[int(b - a)][int(grams(h[a:b], int(b - a))[0])].append(i)
    walks = walks_for(groups, edits, recall) if groups else 1
    sizes, member, found = [], np.zeros((len(pairs) + 1, len(groups)), bool), [(np.zeros((0, 1), U), 0)]
    for n, length in enumerate(sorted(groups)):
        own = padded(groups[length], length)
        found.append((keys(own, np.full(len(own), length), walks), n))
        member[np.unique(np.concatenate(own_pairs[length])), n] = True
        sizes.append(Size(length, int(length * edits), own[:, :-1], ids[length]))
    key = np.concatenate([k.ravel() for k, _ in found])
    order = np.argsort(key, kind="stable")
    key_size = np.concatenate([np.full(k.size, n) for k, n in found])[order]
    key_item = np.concatenate([np.repeat(np.arange(len(k)), k.shape[1]) for k, _ in found])[order]
    short = {}
    for length, own in sorted(brief.items()):
        whole = np.array(sorted(own), U)
        short[length] = whole, table_of(whole), [own[x] for x in sorted(own)]
    return Index(vocabulary, coarse, pairs, coarse_pairs, member, sizes, key[order], key_size, key_item, walks, short)


def near_ends(item: np.ndarray, text: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """Places in ``text`` within ``limit`` word edits of ``item``, as (start, end, edits); the nearest first, none
    overlapping one before."""

    def rows(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else steps.copy()
        for n, x in enumerate(a, 1):
            new = np.empty_like(row)
            new[0] = n
            new[1:] = np.minimum(row[1:] + 1, row[:-1] + ((b != x) | (b == 0)))
            row = np.minimum.accumulate(new - steps) + steps
        return row

    ends, found, taken = rows(item, text, True), [], np.zeros(len(text) + 1, bool)
    for e in np.argsort(ends, kind="stable"):
        d = int(ends[e])
        if d > limit:
            break
        if taken[e]:
            continue
        back = rows(item[::-1], text[:e][::-1], False)
        s = int(e) - int(np.flatnonzero(back == d)[0])
        if any(s < f[1] and e > f[0] for f in found):
            continue
        found.append((s, int(e), d))
        taken[max(0, s + 1) : e + len(item) // 2] = True
    return found


def search(x: Index, texts: pa.Array) -> list[list[tuple]]:
    """For each text the places found, as (item id, start, end, edits, item words) by words of the text."""
    w = read(texts)
    h = w.hashes()
    code = coded(x.vocabulary, x.coarse, h)
    total = len(code)
    text_of = np.repeat(np.arange(len(texts)), np.diff(w.of))
    first_of, end_of = (w.of[:-1][text_of], w.of[1:][text_of]) if total else (w.of[:0], w.of[:0])
    pair = coded(x.pairs, x.coarse_pairs, grams(h, 2))
    hit = np.flatnonzero(pair)
    hit = hit[text_of[hit] == text_of[hit + 1]]
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for n, size in enumerate(x.sizes):
        at = hit[x.member[pair[hit], n]]
        need = max(1, size.length - 1 - 2 * size.limit)
        low, high = at[need - 1 :], at[: max(0, len(at) - need + 1)]
        close = (low - high <= size.length - 2) & (text_of[low] == text_of[high])
        low, high = low[close] - (size.length - 2), high[close]
        if not len(high):
            continue
        # Windows from low to high of each stretch, each window once.
        low = np.maximum(np.maximum(low, first_of[high]), np.concatenate(([-1], np.maximum.accumulate(high)[:-1])) + 1)
        spans = np.maximum(high - low + 1, 0)
        start = np.repeat(low - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        ends = np.minimum(start + size.length, end_of[start])
        whole = ends - start >= size.length - size.limit
        windows.append((start[whole], ends[whole], np.full(int(whole.sum()), n)))
    found: list[list[tuple]] = [[] for _ in range(len(texts))]
    candidates: dict[tuple[int, int, int], set[int]] = defaultdict(set)
    starts, ends, kinds = (np.concatenate(c) for c in zip(*windows, strict=True)) if windows else (hit[:0], hit[:0], hit[:0])
    lengths = np.array([size.length for size in x.sizes], np.int64)
    for at in range(0, len(starts), WINDOWS):
        s, e, n = starts[at : at + WINDOWS], ends[at : at + WINDOWS], kinds[at : at + WINDOWS]
        column = s[:, None] + np.arange(int(lengths[n].max()) + 1)
        rows = np.where(column < e[:, None], code[np.minimum(column, total - 1)], -1).astype(np.int64)
        made = keys(rows, lengths[n], x.walks)
        left = np.searchsorted(x.keys, made.ravel(), side="left")
        right = np.searchsorted(x.keys, made.ravel(), side="right")
        for k in np.flatnonzero(right > left):
            i = k // made.shape[1]
            for j in range(left[k], right[k]):
                if x.key_size[j] == n[i]:
                    candidates[int(text_of[s[i]]), int(n[i]), int(x.key_item[j])].add(int(s[i]))
    for (d, n, item), held in candidates.items():
        size, at = x.sizes[n], sorted(held)
        cuts = [0, *(k for k in range(1, len(at)) if at[k] - at[k - 1] > size.length), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            low = max(int(w.of[d]), at[a] - size.limit)
            high = min(int(w.of[d + 1]), at[b - 1] + size.length + size.limit)
            for s, e, edits in near_ends(size.codes[item], code[low:high], size.limit):
                found[d].append((size.ids[item], int(low + s - w.of[d]), int(low + e - w.of[d]), edits, size.length))
    for length, (whole, coarse, ids) in x.short.items():
        which = coded(whole, coarse, grams(h, length))
        free: dict[tuple[int, int], int] = {}
        for at in np.flatnonzero(which):
            d, item = int(text_of[at]), int(which[at]) - 1
            if text_of[at + length - 1] == d and at >= free.get((d, item), 0):
                free[d, item] = int(at) + length
                found[d] += [(i, int(at - w.of[d]), int(at + length - w.of[d]), 0, length) for i in ids[item]]
    return [sorted(set(f), key=lambda p: (p[1], p[2], str(p[0]))) for f in found]


def scan(df: DataFrame, items: DataFrame, text: str = "text", leaks: str = "leaks", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """Add to each row the list ``leaks`` of structs item_id, start, end, edits, item_words. No shuffle.

    Items come to the driver in blocks of about BLOCK_ITEMS and BLOCK_BYTES, each block one pass over the rows, so the
    index that travels is bounded. Null and empty texts have no leaks; whole texts are searched; null and wordless
    items are left out. Items under MIN_WORDS words are found without edits; one of one common word is found wherever
    that word is. Repeated rows and items are searched each by itself; of equally near places that overlap the
    first is told.
    """
    names = [n for n in (df.columns if keep is None else keep) if n != leaks]
    hidden = text if text in names else fresh(names + [leaks], "text_read")[0]
    read = df.select(*names) if hidden in names else df.select(*names, F.col(text).alias(hidden))
    kind = items.schema[item_id].dataType.simpleString()
    listed = f"array<struct<item_id:{kind},start:int,end:int,edits:int,item_words:int>>"
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    out = read.withColumn(leaks, F.array().cast(listed))
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b).select(item_id, item_text).collect()
        sent = df.sparkSession.sparkContext.broadcast(index([tuple(r) for r in sorted(own, key=str)], edits))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part, texts in slices(batches, hidden, SHINGLED_BYTES):
                column = part.schema.get_field_index(leaks)
                struct = part.schema.field(column).type.value_type
                before = part.column(column).to_pylist()
                rows = [old + [dict(zip(("item_id", "start", "end", "edits", "item_words"), f, strict=True)) for f in new] for old, new in zip(before, search(sent.value, texts), strict=True)]
                yield part.set_column(column, leaks, pa.array(rows, pa.list_(struct)))

        out = out.mapInArrow(run, out.schema)
    return out if hidden in names else out.drop(hidden)


def decontaminated(df: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` in whose text no item is found."""
    leaks = fresh(df.columns, "leaks")[0]
    return scan(df, items, text, leaks, **how).filter(F.size(leaks) == 0).select(*df.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
