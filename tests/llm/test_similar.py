"""N-gram Jaccard join and line dedup against plain sets."""

import random
import re

import pytest

from quadrille.llm.jaccard import jaccard_components, one_of_each, op2_jaccard_join
from quadrille.llm.linededup import OP6_SQL, line_dedup, op6_line_dedup

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar(a: frozenset, b: frozenset) -> bool:
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def plain_components(docs: list[tuple]) -> dict:
    sets = [(k, shingles(t)) for k, t in docs]
    root = {k: k for k, _ in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, s) in enumerate(sets):
        for b, z in sets[:i]:
            if similar(s, z):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets}


def corpus(seed: int, n: int = 120) -> list[tuple]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, k=r.choice([3, 8, 20, 60])))) for i in range(n // 2)]
    while len(docs) < n:
        w = r.choice(docs)[1].split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((len(docs), (" " if r.random() < 0.5 else "\t\n").join(w).swapcase() if r.random() < 0.2 else " ".join(w)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "  \n "), (n + 3, "x " * 30_000), (n + 4, "X " * 30_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(make, seed):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(make(docs)).collect()}
    assert got == plain_components(docs)


def test_hot_groups_chains_and_empty_tables(make):
    base = [f"b{i}" for i in range(60)]
    chain = []
    for i in range(30):  # each is near the next, the ends are not near each other
        chain.append((i, " ".join(base[i : i + 50])))
    copies = [(100 + i, "one two three four five six") for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(make(chain + copies)).collect()}
    assert all(got[i] == 0 for i in range(11)) and all(got[100 + i] == 100 for i in range(300))
    assert got == {k: c for k, (_, c) in plain_components(chain + copies).items()}
    assert jaccard_components(make([])).count() == 0


def test_one_of_each(make):
    docs = corpus(5, 60)
    want = {k for k, (_, c) in plain_components(docs).items() if c == k}
    kept = one_of_each(make(docs))
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == make(docs).columns


def test_null_and_repeated_keys(make):
    base = [f"b{i}" for i in range(60)]
    text = lambda i: " ".join(base[i : i + 50])
    rows = [(0, text(0)), (None, text(1)), (5, text(2)), (7, text(3)), (7, "quite another text of its own"), (7, "quite another text of its own"), (9, "Quite another TEXT of its own"), (None, "no key at all"), (None, "no key at all"), (8, None), (8, "")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_components(make(rows)).collect())
    assert got == sorted([("0", 46, "0"), ("None", 46, "0"), ("5", 46, "0"), ("7", 46, "0"), ("7", 2, "7"), ("7", 2, "7"), ("9", 2, "7"), ("None", 1, "None"), ("None", 1, "None"), ("8", 0, "8"), ("8", 0, "8")])
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in one_of_each(make(rows)).collect())
    assert kept == sorted([("0", text(0)), ("7", rows[4][1]), ("None", "no key at all"), ("8", "None"), ("8", "")])


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_jaccard_join(spark, DATA).collect()}
    assert got == plain_components(docs)


# --- lines -------------------------------------------------------------------------------------------------------


def plain_lines(docs: list[tuple]) -> dict:
    out, before = {}, []
    for k, t in sorted(docs):
        kept = []
        for line in (t or "").split("\n"):
            s = shingles(line)
            if not any(similar(s, z) for z in before):
                kept.append(line)
            if s:
                before.append(s)
        out[k] = None if t is None else "\n".join(kept)
    return out


def pages(seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    lines = [" ".join(r.choices(words, k=r.choice([1, 2, 6, 30, 60]))) for _ in range(25)]
    docs = []
    for i in range(30):
        own = []
        for _ in range(r.choice([1, 4, 8])):
            w = r.choice(lines).split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                w[r.randrange(len(w))] = r.choice(words)
            own.append(" ".join(w))
            own += [""] * (r.random() < 0.2)
        docs.append((i, "\n".join(own)))
    return docs + [(40, None), (41, ""), (42, "\n\n"), (43, "Footer Line"), (44, "footer line\nother")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup(make, seed):
    docs = pages(seed)
    made = line_dedup(make(docs))
    assert {r["doc_id"]: r["text"] for r in made.collect()} == plain_lines(docs)
    assert made.columns == make(docs).columns


def test_lines_of_repeated_rows_and_null_keys(make):
    rows = [(1, "a b c\nd e f"), (1, "a b c\nd e f"), (None, "d e f"), (2, "a b c")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup(make(rows)).collect())
    assert got == [("1", "a b c"), ("1", "a b c"), ("2", ""), ("None", "d e f")]
    assert line_dedup(make([])).count() == 0


def test_lines_with_common_passages(make):
    r = random.Random(4)
    passage, footer = " ".join(f"p{i}" for i in range(12)), " ".join(f"f{i}" for i in range(25))
    docs = []
    for i in range(40):
        own = " ".join(f"w{r.randrange(500)}" for _ in range(r.choice([2, 6, 12])))
        docs.append((i, f"{own} {passage}\n{footer} {i}\n{passage} {own} x{i}" + "\nVery long " * (i == 3) + "z " * 40_000 * (i == 3)))
    assert {r["doc_id"]: r["text"] for r in line_dedup(make(docs)).collect()} == plain_lines(docs)


@pytest.mark.parametrize("busy", [2, 5])
def test_lines_of_large_families(make, monkeypatch, busy):
    """Lines of families that are alike to all degrees, and buckets beyond those of which all meet, without Python."""
    from pyspark.sql import DataFrame

    from quadrille.llm import linededup

    monkeypatch.setattr(linededup, "BUSY", busy)
    monkeypatch.setattr(DataFrame, "mapInArrow", None)
    r = random.Random(11)
    docs = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(r.choice([8, 20, 45]))]
        for _ in range(20):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = f"e{r.randrange(9999)}"
            docs.append((len(docs), " ".join(w[r.choice([0, 0, 1, 3]) :] + w[:5] * (r.random() < 0.3))))
    r.shuffle(docs)
    assert {x["doc_id"]: x["text"] for x in line_dedup(make(docs)).collect()} == plain_lines(docs)


def test_line_query(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(OP6_SQL).fetchall()}
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in op6_line_dedup(spark, DATA).collect()} == want
