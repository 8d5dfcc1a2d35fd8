"""Benchmark decontamination, license scan and nearest neighbours against plain search."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quadrille.llm.decontamination import decontaminated, scan
from quadrille.llm.licenses import NOTICES, OP7_SQL, op7_license_scan
from quadrille.llm.licenses import scan as license_scan
from quadrille.llm.neighbours import Index, Ranker, kmeans, nearest, op10_nearest_neighbours, search, traversed

DATA = "/root/testdata/sf0.001"


def least_edits(item: list[str], text: list[str]) -> int:
    """The least word edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks(spark, make):
    r = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(words, k=r.choice([6, 12, 30])))) for i in range(15)] + [(90, None), (91, ""), (92, "too short")]
    docs = []
    for d in range(120):
        body = r.choices(words, k=r.choice([20, 200]))
        if d % 2:
            w = r.choice(items[:15])[1].split()
            for _ in range(int(len(w) * 0.2) if d % 4 == 1 else 0):
                p, kind = r.randrange(len(w)), r.randrange(3)
                if kind == 0:
                    w[p] = r.choice(words)
                elif kind == 1:
                    w.insert(p, r.choice(words))
                elif len(w) > 1:
                    del w[p]
            body[10:10] = w
        docs.append((d, " ".join(body).title() if d % 3 else ", ".join(body)))
    docs += [(500, None), (501, ""), (502, " ".join(r.choices(words, k=30_000)))]
    got = {(x["doc_id"], leak["item_id"]) for x in scan(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect() for leak in x["leaks"]}
    want = set()
    for d, t in docs[:-1]:
        w = (t or "").lower().replace(",", " ").split()
        for i, item in items[:15]:
            if least_edits(item.split(), w) <= int(len(item.split()) * 0.2):
                want.add((d, i))
    assert not {p for p in got if p[0] != 502} - want, "a leak that is none"
    assert len(want & got) >= 0.97 * len(want), "recall"
    exact = {(d, i) for d, t in docs for i, item in items[:15] if t and item in t.lower().replace(",", "")}
    assert exact <= got
    kept = decontaminated(make(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {x["doc_id"] for x in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got} and kept.columns == make(docs).columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminated(make(docs), none).count() == len(docs)
    assert scan(make([]), none).count() == 0


def test_short_items_and_scripts_without_blanks(spark, make):
    items = [(1, "Zürich"), (2, "blue whale"), (3, "a b a b"), (4, "东京在哪里"), (5, "ประเทศไทย"), (6, "日本の首都は東京であり、人口は約千四百万人である。"), (7, "𠀀𠀁"), (8, "blue whale"), (9, "?!")]
    docs = [
        (1, "From ZÜRICH on"), (2, "The Blue-Whale! blue whales"), (3, "a b a b a b a"), (4, "请问，东京在哪里？谢谢。"), (5, "อยู่ในประเทศไทยครับ"), (6, "昔、日本の首都は京都であり、人口は約千四百万人であるという。"),
        (7, "x𠀀𠀁y"), (8, "blue"), (9, "whale"), (10, "东京在那里"), (11, "zürichs blue b a b"), (12, None),
    ]
    got = {(x["doc_id"], leak["item_id"], leak["start"], leak["end"]) for x in scan(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect() for leak in x["leaks"]}
    assert {g for g in got if g[1] != 6} == {(1, 1, 1, 2), (2, 2, 1, 3), (2, 8, 1, 3), (3, 3, 0, 4), (4, 4, 2, 7), (5, 5, 6, 15), (7, 7, 1, 3)} | {g for g in got if g[:2] == (10, 4)}
    assert {g[:2] for g in got if g[1] == 6} == {(6, 6)}


def test_notices(spark, make):
    notice = NOTICES["MIT"][2]
    words = notice.split()
    words[12] = "changed"
    docs = [(1, "Some words. " + notice + " more"), (2, " ".join(words)), (3, "word " * 50_000 + notice), (4, None), (5, ""), (6, "Permission is hereby granted"), (7, notice + "\n" + "x " * 300 + notice)]
    got = sorted((r["doc_id"], r["license"], r["notice"]) for r in license_scan(make(docs)).collect())
    assert [g for g in got if g[1:] == ("MIT", 2)] == [(d, "MIT", 2) for d in (1, 2, 3, 7, 7)]
    assert license_scan(make([])).count() == 0


def test_notice_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted((*r[:4], round(r[4], 9)) for r in con.execute(OP7_SQL).fetchall())
    got = sorted((r["doc_id"], r["license"], r["notice"], r["position"], round(r["contained"], 9)) for r in op7_license_scan(spark, DATA).collect())
    assert got == want and got


def test_short_notices_beside_long_ones(spark, make):
    short = ["Licensed under the MIT License.", "Released under the MIT License.", "Licensed under CC BY 4.0."]
    long = [NOTICES["MIT"][2], NOTICES["GPL-3.0"][1], NOTICES["Apache-2.0"][1], NOTICES["BSD-3-Clause"][0]]
    texts = [" ".join(["word"] * shift + parts) for shift in range(16) for s in short for a, b in zip(long, long[1:] + long[:1], strict=True) for parts in ([s, a], [a, s], [a, s, b])]
    spread = NOTICES["GPL-3.0"][1].split()
    spread[20] = spread[33] = "changed"
    texts += [" ".join(spread[:8] + ["more"] * 9 + spread[8:])]
    docs = make(list(enumerate(texts)))
    con = duckdb.connect()
    con.register("listed", docs.select("doc_id", "text").toPandas())
    con.execute("CREATE VIEW documents AS SELECT * FROM listed")
    want = sorted((*r[:4], round(r[4], 9)) for r in con.execute(OP7_SQL).fetchall())
    got = sorted((r["doc_id"], r["license"], r["notice"], r["position"], round(r["contained"], 9)) for r in license_scan(docs).collect())
    assert got == want and {r[0] for r in want} >= set(range(len(texts) - 1))


def exact_nearest(ids, v, asked, k):
    out = {}
    for q in asked:
        s = (v * v[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact_nearest(np.arange(3000), v, range(0, 3000, 20), 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    recall = np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    for q, rows in got.items():
        for i, s in rows:
            assert abs(s - float((v[i] * v[q]).sum())) < 1e-9
        assert rows == sorted(rows, key=lambda p: (-p[1], p[0]))


def recall_on(spark, sf: str, found) -> float:
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
    rows = [r for r in rows if r["embedding"] is not None and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])]
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = exact_nearest(ids, v, np.flatnonzero(ids % 20 == 0), 20)
    got: dict[int, list] = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys()
    return np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_of_the_query(spark, monkeypatch):
    """As registered, and on 2,000 vectors without the least number of rows, in several blocks."""
    monkeypatch.setattr("quadrille.llm.neighbours.QUERY_ROWS", 40)
    assert recall_on(spark, "sf0.01", op10_nearest_neighbours(spark, "/root/testdata/sf0.01")) >= 0.9
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall_on(spark, "sf0.1", search(df, F.col("vec_id") % 20 == 0, least=0)) >= 0.9


def test_the_index_saves_products():
    """What is multiplied is what the visited cells hold; a smaller share makes fewer products."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(4000, 16)) + 4 * rng.normal(size=(30, 16))[rng.integers(0, 30, 4000)]
    first, second = kmeans(v[:, :8], 16), kmeans(v[:, 8:], 16)
    cell = nearest(v[:, :8], first) * 16 + nearest(v[:, 8:], second)
    x = Index(8, first, second, np.bincount(cell, minlength=256).reshape(16, 16))
    ids, asks, recall, made = np.arange(4000), np.arange(0, 4000, 20), {}, {}
    want = exact_nearest(ids, v, asks, 20)
    for share in (0.05, 0.2, 1.0):
        visits = [traversed(v[a], x, int(share * 4000)) for a in asks]
        bits = np.zeros((256, len(asks)), bool)
        for i, cells in enumerate(visits):
            bits[cells, i] = True
            assert cells == plain_order(v[a := asks[i]], x, int(share * 4000)), a
        ranker = Ranker(asks, v[asks], np.packbits(bits, axis=1), np.full(len(asks), -np.inf), 20)
        for c in range(256):
            ranker.meet(c, v[cell == c], ids[cell == c])
        who, _, found = ranker.settle()
        made[share] = ranker.products
        assert made[share] == sum(x.sizes.flat[cells].sum() for cells in visits) <= (share + 0.15) * len(asks) * 4000
        recall[share] = np.mean([len(set(found[who == i]) & {a for a, _ in want[q]}) / 20 for i, q in enumerate(asks)])
    assert made[0.05] < made[0.2] < made[1.0] and recall[1.0] == 1 and recall[0.2] >= 0.9


def plain_order(q, x, wanted):
    """Cells by summed distance until they hold enough, by sorting all pairs."""
    d = -(x.first @ q[: x.split])[:, None] - (x.second @ q[x.split :])[None, :]
    out, held = [], 0
    for c in np.argsort(d, axis=None, kind="stable"):
        if held >= wanted:
            break
        if x.sizes.flat[c]:
            out.append(int(c))
            held += x.sizes.flat[c]
    return out


def test_repeated_keys_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as cell", "'x' as score", "3 as v")
    got = [tuple(r) for r in search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 1, 2.0)]


def test_few_odd_and_equal_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.5, 0.5]), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 1.0), (0, 3, 9, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 1.0), (20, 3, 9, 0.5)]
    assert search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
