"""Numpy kernels over Arrow string columns: words, their hashes and shingle hashes, without a loop per word."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes that are worked on at once; a single longer text is one slice by itself.
SLICE_BYTES = 2 << 20
#: The same where words are hashed and ordered, which takes up to a hundred times the bytes.
SHINGLED_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(7))
#: A random 64-bit value per byte, and an odd multiplier with its inverse modulo 2**64.
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

_powers = {1: np.ones(1, U), -1: np.ones(1, U)}


def powers(n: int, sign: int) -> np.ndarray:
    have = _powers[sign]
    if len(have) < n:
        step = np.full(max(n, 1 << 20), U(BASE if sign > 0 else INVERSE), U)
        step[0] = U(1)
        _powers[sign] = have = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_class(separators: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


def lower_ascii() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


#: The white space of [^\x20\x09-\x0D]+ and, for looser words, every ASCII byte but letters and digits.
SPACES = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
NOT_ALNUM = byte_class(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = lower_ascii()
#: First code points of stretches by kind: 0 others, 1 characters of scripts that put no blanks between words, 2 their
#: punctuation. Thai, Lao, Tibetan, Myanmar, Khmer and other scripts of South East Asia; Chinese and Japanese.
STRETCHES = np.array([
    (0x0000, 0), (0x0E00, 1), (0x0F0B, 2), (0x0F15, 1), (0x1000, 1), (0x104A, 2), (0x1050, 1), (0x10A0, 0), (0x1780, 1), (0x17D4, 2), (0x17D7, 1), (0x17D8, 2), (0x17DB, 1), (0x1800, 0),
    (0x1950, 1), (0x1AB0, 0), (0x1B00, 1), (0x1B80, 0), (0x2E80, 1), (0x2FF0, 2), (0x3005, 1), (0x3008, 2), (0x3021, 1), (0x3030, 2), (0x3031, 1), (0x303D, 2), (0x3041, 1), (0x30A0, 2), (0x30A1, 1), (0x30FB, 2), (0x30FC, 1), (0x3130, 0),
    (0x31A0, 1), (0x3200, 0), (0x3400, 1), (0x4DC0, 0), (0x4E00, 1), (0xA000, 0), (0xA980, 1), (0xAA00, 0), (0xAA60, 1), (0xAAE0, 0), (0xF900, 1), (0xFB00, 0), (0xFE30, 2), (0xFE50, 0),
    (0xFF01, 2), (0xFF10, 0), (0xFF1A, 2), (0xFF21, 0), (0xFF3B, 2), (0xFF41, 0), (0xFF5B, 2), (0xFF66, 1), (0xFFA0, 0), (0x1B000, 1), (0x1B170, 0), (0x20000, 1), (0x40000, 0),
])


@dataclass
class Words:
    data: np.ndarray  # folded bytes
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray
    of: np.ndarray  # words of text d: of[d] to of[d + 1]
    running: np.ndarray  # running[i]: hash sum of the first i bytes

    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.running[ends] - self.running[starts]
        h *= powers(len(self.running), -1)[starts]
        return mix(h)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def without_blanks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte length and kind of the characters of STRETCHES in UTF-8 bytes."""
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return at, at, at
    size = np.where(data[at] >= 0xF0, 4, 3)
    b = [data[at + j].astype(np.int64) & 63 for j in range(1, 3)]
    point = (data[at].astype(np.int64) & 15) << 12 | b[0] << 6 | b[1]
    four = np.flatnonzero(size == 4)
    point[four] = (point[four] & 0x7FFF) << 6 | data[at[four] + 3] & 63
    kind = STRETCHES[np.searchsorted(STRETCHES[:, 0], point, side="right") - 1, 1]
    return at[kind > 0], size[kind > 0], kind[kind > 0]


def words(texts: pa.Array, separators: np.ndarray, fold: np.ndarray = LOWER, apart: bool = False) -> Words:
    """With ``apart``, characters of scripts without blanks are words each, and their punctuation parts words."""
    data, offsets = buffers(texts)
    n = len(data)
    alone = without_blanks(data) if apart else None
    apart = separators[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    if alone is not None and len(alone[0]):
        at, size, kind = alone
        first[at] = first[at + size] = True
        for j in range(4):
            apart[at[(kind == 2) & (size > j)] + j] = True
    inside = ~apart
    before = np.ones(n, bool)
    if n:
        before[1:] = apart[:-1]
        before |= first[:n]
    starts = np.flatnonzero(inside & before)
    after = np.ones(n, bool)
    if n:
        after[:-1] = apart[1:]
        after |= first[1:]
    ends = np.flatnonzero(inside & after) + 1
    folded = fold[data]
    running = np.zeros(n + 1, U)
    np.cumsum(BYTE_VALUES[folded] * powers(n, 1), out=running[1:])
    return Words(folded, starts, ends, np.searchsorted(starts, offsets), running)


def table_of(hashes: np.ndarray) -> np.ndarray:
    """By the top 20 bits, whether any of the hashes has them."""
    out = np.zeros(1 << 20, bool)
    out[(hashes >> U(44)).astype(np.int64)] = True
    return out


def coded(vocabulary: np.ndarray, coarse: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place, from 1, of each hash in the sorted vocabulary; 0 for others. ``coarse`` is its table_of()."""
    out = np.zeros(len(h), np.int32)
    at = np.flatnonzero(coarse[(h >> U(44)).astype(np.int64)])
    if len(at) and len(vocabulary):
        i = np.minimum(np.searchsorted(vocabulary, h[at]), len(vocabulary) - 1)
        same = vocabulary[i] == h[at]
        out[at[same]] = i[same] + 1
    return out


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` neighbouring word hashes; those across two texts are there too."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n] * SHINGLE_FACTORS[0]
    for j in range(1, size):
        out += h[j : n + j] * SHINGLE_FACTORS[j]
    return mix(out)


def shingles(w: Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, without words none."""
    h = w.hashes()
    all_grams = grams(h, size)
    for a, b in zip(w.of[:-1], w.of[1:], strict=True):
        n = int(b - a)
        if n >= size:
            s = np.sort(all_grams[a : b - size + 1])
            yield s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            yield mix((h[a:b] * SHINGLE_FACTORS[:n]).sum(keepdims=True) + U(n))
        else:
            yield np.zeros(0, U)


def sequence_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each text's word sequence."""
    h = w.hashes()
    place = np.arange(len(h)) - np.repeat(w.of[:-1], np.diff(w.of))
    keys = []
    for salt in (U(0x51ED270B), U(0x2545F491)):
        term = mix((h ^ salt) * (mix(place.astype(U) + salt) | U(1)))
        total = np.zeros(len(h) + 1, U)
        np.cumsum(term, out=total[1:])
        keys.append(mix(total[w.of[1:]] - total[w.of[:-1]] + np.diff(w.of).astype(U)))
    return keys[0], keys[1]


def give_back() -> None:
    """Return to the system what Arrow and, by glibc, numpy have freed: a worker stays for other stages, beside a heap that
    cannot shrink."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, rows: int = 1 << 31) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches so that their texts hold at most ``limit`` bytes together, a longer text being a slice by itself, and
    are at most ``rows``; null texts come as empty. At the end unused memory is given back."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(sizes, base + limit, side="right"))))
            part = batch.slice(at, to - at)
            yield part, pc.fill_null(part.column(text), "")
            at = to
    give_back()
