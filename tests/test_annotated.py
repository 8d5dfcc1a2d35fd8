"""Annotation collections as data sources."""

import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.sources import annotated, datasets

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(), v, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.lists(VALUES, max_size=5), st.integers(1, 9), st.sampled_from([None, 2]), st.booleans())
def test_streams_read_what_whole_documents_hold(other, items, chunk, indent, ascii_only):
    doc = json.dumps({"other": other, "items": items, "last": {"x": items}}, indent=indent, ensure_ascii=ascii_only).encode("utf-8", "surrogatepass")
    try:
        doc.decode()
    except UnicodeDecodeError:
        return
    whole = json.loads(doc)
    assert [v for _, v in annotated.entries(io.BytesIO(doc), "items", chunk)] == whole["items"]
    assert dict(annotated.entries(io.BytesIO(doc), "last", chunk)) == whole["last"]
    assert dict(annotated.entries(io.BytesIO(doc), None, chunk)) == whole


@pytest.mark.parametrize("doc", ['{"items": [1, 2', '{"items": [1 2]}', '{"items": 3}', "[", "", '{"items" [1]}', '{"items": [1,]}'])
def test_damaged_documents_are_errors(doc):
    with pytest.raises(annotated.DamagedDocument):
        list(annotated.entries(io.BytesIO(doc.encode()), "items", 4))


def test_a_long_document_is_never_held_whole():
    items = [{"id": str(i), "question": "q" * 100} for i in range(20_000)]
    doc = json.dumps({"questions": items}).encode()
    s = annotated.Stream(io.BytesIO(doc), 4096)
    most = 0
    for name in s.children():
        assert name == "questions"
        for i, _ in enumerate(s.children()):
            assert s.value() == items[i]
            most = max(most, len(s.text))
    assert most < 20_000 < len(doc)


@pytest.fixture
def root(tmp_path):
    (tmp_path / "questions.json").write_text(json.dumps({"info": {"n": [1]}, "questions": [{"id": 1, "image_id": "a", "type": "count", "question": "how many ü"}, {"id": "2", "image_id": "a", "question": "is there"}, {"id": "3", "image_id": "b", "question": None}]}))
    (tmp_path / "answers.json").write_text(json.dumps({"answers": [{"id": "1", "answer": "3"}, {"id": 1, "answer": 4}, {"id": "9", "answer": "x"}]}))
    (tmp_path / "change_qa.json").write_text(json.dumps({"pairs": {"p": [{"question": "q", "answer": "yes"}], "none": []}}))
    (tmp_path / "vrsbench_annotations.json").write_text(json.dumps({"s": {"caption": "x"}, "t": "words", "u": None}))
    return str(tmp_path)


def rows(df):
    return sorted(map(str, df.collect()))


def test_documents(spark, root):
    annotated.register(spark)
    read = lambda name, **o: spark.read.format(name).options(**o).load(root)
    asked = read("rsvqa")
    assert asked.orderBy("place").first().asDict() == {"place": 0, "id": "1", "image_id": "a", "type": "count", "question": "how many ü"}
    assert read("rsvqa", table="answers").filter("id = '1'").orderBy("at").select("answer").collect()[-1][0] == "4"
    assert rows(annotated.questions(spark, root)) == rows(datasets.rsvqa(spark, root))
    assert rows(read("cdvqa")) == rows(datasets.cdvqa(spark, root))
    assert rows(read("vrsbench")) == rows(datasets.vrsbench(spark, root))
    with pytest.raises(Exception, match="no table sums"):
        read("rsvqa", table="sums").collect()


def test_roots_that_are_not_mounted(spark, tmp_path):
    annotated.register(spark)
    for name in ("rsvqa", "cdvqa", "vrsbench", "landcover"):
        got = spark.read.format(name).load(str(tmp_path / "none"))
        assert got.count() == 0 and got.columns
    assert annotated.questions(spark, str(tmp_path)).count() == 0


def test_damage_names_the_file(spark, tmp_path):
    annotated.register(spark)
    (tmp_path / "change_qa.json").write_text('{"pairs": {"p": [{"question"')
    with pytest.raises(Exception, match="change_qa.json"):
        spark.read.format("cdvqa").load(str(tmp_path)).collect()


def test_land_cover_by_patches(spark, tmp_path):
    annotated.register(spark)
    for i in range(10):
        (tmp_path / f"p{i}").mkdir()
        (tmp_path / f"p{i}" / f"p{i}_labels_metadata.json").write_text(json.dumps({"labels": ["Pastures", "Unknown", "Airports"][: i % 4]}))
        for b in range(i % 3):
            (tmp_path / f"p{i}" / f"p{i}_B0{b}.tif").write_bytes(b"x")
    (tmp_path / "bare").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "note.txt").write_text("x")
    read = lambda: spark.read.format("landcover").option("splitPatches", 4).load(str(tmp_path))
    got = {r["patch_id"]: r for r in read().collect()}
    assert len(got) == 11 and read().rdd.getNumPartitions() == 3
    assert got["p3"]["labels"] == ["Pastures", "Airports"] and got["p5"]["files"] == ["p5_B00.tif", "p5_B01.tif"] and got["bare"]["labels"] == got["bare"]["files"] == []
    assert rows(read().filter("patch_id <> 'bare'")) == rows(datasets.land_cover(spark, str(tmp_path)))


def test_patches_asked_for_are_the_only_ones_opened(spark, tmp_path):
    annotated.register(spark)
    for name in ("good", "damaged"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}_labels_metadata.json").write_text('{"labels": ["Airports"]}' if name == "good" else "{")
    read = lambda *names: spark.read.format("landcover").option("patches", json.dumps(names)).load(str(tmp_path))
    assert read("good").first()["labels"] == ["Airports"]
    assert read("good", "absent").count() == 1 and read("../good", "").count() == 0
    with pytest.raises(Exception, match="damaged_labels_metadata.json"):
        spark.read.format("landcover").load(str(tmp_path)).collect()


def test_filters_of_one_table_do_not_meet(spark, tmp_path):
    annotated.register(spark)
    for name in "abc":
        (tmp_path / name).mkdir()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("landcover").load(str(tmp_path))
    a, b = (df.filter(F.col("patch_id") == x) for x in "ab")
    assert a.count() == 1 and df.count() == 3 and sorted(r["patch_id"] for r in a.union(b).collect()) == ["a", "b"]
