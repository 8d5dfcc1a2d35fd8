"""The pipeline's stages against plain versions, each on its own input."""

import random

import pytest
from pyspark.sql import functions as F
from test_search import least_edits
from test_similar import plain_components, plain_lines

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    r = random.Random(9)
    en, de = "the a of and river house day light green stone under over bright small long".split(), "das der und fluss haus tag licht grün stein unter über hell klein lang ein".split()
    docs = []
    for i in range(80):
        words = [w + str(r.randrange(40)) * (r.random() < 0.5) for w in r.choices(de if i % 3 == 0 else en, k=r.choice([10, 40, 90]))]
        docs.append([i, " ".join(words[:20]) + "\n" + " ".join(words[20:]), "de" if i % 3 == 0 else "en"])
    docs[10][1], docs[11][1] = docs[4][1], docs[4][1] + " stone"
    item = "seven bright stones lie under the long green river of light and no one knows"
    docs[20][1] += "\n" + item
    rows = [(*d, "src", len(d[1])) for d in docs] + [(200, None, "en", "s", 0), (201, "12345 !!", None, "s", 8), (202, "", "de", "s", 0)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), item


def test_stages(spark, data, tmp_path):
    at, item = data
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, kept = docs.columns, []
    for n, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, at).write.parquet(str(tmp_path / f"{n}"))
        docs = spark.read.parquet(str(tmp_path / f"{n}"))
        after = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            assert set(before) - set(after) == {200, 201, 202}
        elif name == "line_dedup":
            want = plain_lines(list(before.items()))
            assert {k: r["text"] for k, r in after.items()} == want and all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "near_duplicates":
            assert set(after) == {k for k, (_, c) in plain_components(list(before.items())).items() if c == k}
        elif name == "decontamination":
            limit = int(len(item.split()) * 0.2)
            assert set(after) == {k for k, t in before.items() if least_edits(item.split(), t.lower().split()) > limit}
            kept = set(after)
        else:
            assert set(after) == kept
    assert len(pipeline.STAGES) == 5


def test_run(spark, data):
    rows = pipeline.run(spark, data[0]).collect()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    kept = {r["doc_id"] for r in rows}
    assert not kept & {20, 200, 201, 202} and len(kept) > 60 and len(rows) == len({(r["doc_id"], r["piece"]) for r in rows})


def test_language_stage_without_labels_and_odd_tables(spark, data):
    docs = spark.read.parquet(f"{data[0]}/documents.parquet").selectExpr("*", "'x' as block", "1 as k", "2 as score", "3 as row")
    kept = pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), data[0])
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    long = spark.createDataFrame([(900, "river stone " * 60_000, "en", "s", 720_000), (900, "river stone " * 60_000, "en", "s", 720_000), (None, "das haus und der fluss", None, None, None)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    for rows in (docs.limit(0), docs.unionByName(long, allowMissingColumns=True)):
        for _, stage in pipeline.STAGES[:-1]:
            made = stage(spark, rows, data[0])
            assert made.columns == docs.columns and (made.count() > 60) == (rows.count() > 0)
    assert pipeline.packing(spark, docs.limit(0), data[0]).count() == 0
