"""Chat formatting and packing: exact round trips."""

import hashlib
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm.chat import TRICKY, digests, formatted, op8_chat_formatting, parsed
from quadrille.llm.packing import op9_packing, pack, places, plan, tokenizer_path

DATA = "/root/testdata/sf0.001"


def plain_digest(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    turns = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"], r["role"] or "", r["text"] or "")):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    turns[-1] = [("user", TRICKY), ("assistant", TRICKY)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in op8_chat_formatting(spark, DATA).collect()}
    assert got == {k: plain_digest(v) for k, v in turns.items()}


def test_chat_edges(spark):
    odd = ["", "\\", "\\\\|", "<|im_end|>", "<\\|", "\\<|im_start|>", "a\n<|im_end|>\n", "é\U0001f600", TRICKY]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(2, 0, None, None), (3, 0, "ro\nle\\n", "x"), (4, 0, "assistant", "long " * 50_000), (4, 1, "assistant", "b"), (5, 0, "user", "twice"), (5, 0, "user", "twice"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'x' as formatted", "1 as part")
    made = formatted(df, part_bytes=1000)
    whole = defaultdict(list)
    for r in made.collect():
        whole[r["conv_id"]] += parsed(r["formatted"])
    assert [t for _, t in whole[1]] == odd and whole[3] == [("ro\nle\\n", "x")] and len(whole[5]) == 2 and len(whole[4][0][1]) == 250_000
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in digests(made).collect()}
    for c in (1, 2, 3, 4, 5, None):
        assert got[c] == plain_digest([(r, t) for k, _, r, t in rows if k == c])
    assert digests(formatted(df.limit(0))).count() == 0


def test_memory_of_formatting_and_slices():
    import tracemalloc

    import pyarrow as pa

    from quadrille.llm.chat import assemble
    from quadrille.llm.textkernel import slices

    texts = pa.array(["long \\ text " * 5_000] * 100 + ["short"] * 10_000)
    tracemalloc.start()
    rows, spans = assemble(pa.array(["assistant"] * len(texts)), texts, np.ones(len(texts), bool), np.arange(len(texts)) % 100 == 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 101 and peak < 4 * texts.nbytes
    assert parsed(rows[0].as_py()) == [("assistant", t) for t in texts[:100].to_pylist()]
    cut = list(slices(iter([pa.record_batch([texts], ["text"])]), "text", rows=256))
    assert sum(len(t) for _, t in cut) == len(texts) and max(len(t) for _, t in cut) == 256 and max(t.nbytes for _, t in cut) < 3 << 20


class Applied:
    """A table of which one knows what mapInArrow would do with its batches."""

    sparkSession = sparkContext = property(lambda self: self)

    def broadcast(self, value):
        self.value = value
        return self

    def mapInArrow(self, run, schema):
        return run


def test_memory_of_lines_in_a_worker():
    """Python workers share an executor's memory with a heap that they cannot shrink."""
    import tracemalloc

    import pyarrow as pa

    from quadrille.llm.linededup import CELLS, prefixes

    texts = pa.array([" ".join(f"w{(i * 7919 + j * j) % 50_000}" for j in range(400)) for i in range(4_000)])
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(range(len(texts))), texts], ["k", "t", "x"])
    run = prefixes(Applied(), np.zeros(CELLS, np.uint64))
    tracemalloc.start()
    made = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == len(texts) and peak < 80 << 20, peak


FREED = """
import numpy as np, pyarrow as pa
from quadrille.llm.textkernel import slices
anon = lambda: int(next(x for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")).split()[1]) >> 10
batch = pa.record_batch([pa.array(["a"])], ["x"])
list(slices(iter([batch]), "x"))
before = anon()
kept = [np.ones(4096) for _ in range(6000)]
top = kept.pop()
del kept
list(slices(iter([batch]), "x"))
assert anon() < before + 40, (before, anon())
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_memory_that_a_task_freed_is_given_back():
    import subprocess

    done = subprocess.run([sys.executable, "-c", FREED], capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(rows, docs, tokenizer, capacity=2048):
    """Ids, cuts and places of all pieces; returns the number of sequences and the least possible."""
    by_doc, by_sequence, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[k], key=lambda r: r["piece"])
        total += len(ids)
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            cut = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and len(cut) == r["length"] and zlib.crc32(cut.tobytes()) == r["ids_crc32"]
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_pack_query(spark, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    used, least = check(op9_packing(spark, DATA).collect(), docs, tokenizer)
    assert used <= least * 1.05 + 1


def test_pack_edges(make, tokenizer):
    docs = [(1, None), (2, ""), (3, "one Two, three!"), (4, "word " * 9000), (5, "same"), (6, "same"), (7, "é́ <|endoftext|> don't O'Neil's  x y"), (8, "\n\t ")]
    check(pack(make(docs)).collect(), docs, tokenizer)
    assert pack(make([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1 .,'!-\n\té́ßİ😀<|>_s", max_size=60))
def test_words_encode_like_texts(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quadrille.llm.packing import coder_of

    ids, bounds = coder_of(tokenizer_path()).encode(pa.array([text]))
    assert ids.tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids and bounds.tolist() == [0, len(ids)]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_piece_once(histogram):
    runs = plan(histogram, 64, groups=6)
    where, n = places(runs)
    seen = defaultdict(int)
    for r in runs:
        assert sum(length for length, _ in r.parts) == 64 - r.room and r.room >= 0
        for length, _ in r.parts:
            seen[length] += r.count
    assert dict(seen) == histogram and n == sum(r.count for r in runs)
