import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quadrille import store
from quadrille.operators import bands, render
from quadrille.schema import RESULT
from quadrille.sources import blocks, datasets, raster


def tiff(frames: list[np.ndarray], deflate=False, order="<", geo=True, nodata=None, rows=None, planar=False) -> bytes:
    """A stripped TIFF, one directory a frame; strips of ``rows`` rows, by channel if ``planar``."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    where = 4
    for a in frames:
        h, w, c = a.shape
        kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        starts, sizes = [], []
        for plane in [a[:, :, i : i + 1] for i in range(c)] if planar else [a]:
            for y in range(0, h, rows or h):
                raw = plane[y : y + (rows or h)].astype(a.dtype.newbyteorder(order)).tobytes()
                raw = zlib.compress(raw) if deflate else raw
                starts, sizes = [*starts, len(out)], [*sizes, len(raw)]
                out += raw
        tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [a.dtype.itemsize * 8] * c), 259: ("H", [8 if deflate else 1]), 273: ("I", starts), 277: ("H", [c]), 278: ("I", [rows or h]), 279: ("I", sizes), 284: ("H", [1 + planar]), 339: ("H", [kind] * c)}
        if geo:
            tags |= {33550: ("d", [10.0, 10.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 83.218, 17.689, 0.0]), 34735: ("H", [1, 1, 0, 1, 2048, 0, 1, 32644])}
        body, entries = bytearray(), []
        base = len(out) + 2 + 12 * (len(tags) + bool(nodata)) + 4
        for tag, (letter, values) in sorted(tags.items()):
            data = struct.pack(order + letter * len(values), *values)
            code = {"H": 3, "I": 4, "d": 12}[letter]
            entries.append((tag, code, len(values), data))
        if nodata:
            entries.append((42113, 2, len(nodata) + 1, nodata.encode() + b"\0"))
        entries.sort()
        struct.pack_into(order + "I", out, where, len(out))
        directory = struct.pack(order + "H", len(entries))
        for tag, code, n, data in entries:
            if len(data) <= 4:
                field = data.ljust(4, b"\0")
            else:
                field = struct.pack(order + "I", base + len(body))
                body += data
            directory += struct.pack(order + "HHI", tag, code, n) + field
        where = len(out) + len(directory)
        out += directory + b"\0\0\0\0" + body
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.float32])
def test_tiff(order, deflate, kind):
    a = (np.arange(5 * 7 * 4) % 250).reshape(5, 7, 4).astype(kind)
    got, tags = raster.decoded(tiff([a], deflate, order))
    assert (got == a).all() and tags[raster.PIXEL_SCALE][0] == 10.0


# --- the data source -------------------------------------------------------------------------------------------------


def planned(path, **options) -> blocks.Reader:
    return blocks.Reader({"path": str(path), "splitbytes": "1", **options})


def read_bytes(reader) -> int:
    return sum(s.size for s in reader.partitions())


def as_array(df, frame=0):
    rows = df.filter(F.col("frame") == frame).collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1, len(rows[0]["samples"])), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = r["samples"]
    return out


@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("deflate", [False, True])
def test_strips_are_partitions(spark, tmp_path, planar, deflate):
    a = (np.arange(16 * 10 * 4) % 60_000).reshape(16, 10, 4).astype(np.uint16)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "s.tif").write_bytes(tiff([a], deflate, rows=4, planar=planar))
    df = blocks.scan(spark, str(tmp_path), split_bytes=1)
    assert df.rdd.getNumPartitions() == 4
    assert (as_array(df) == a).all() and df.select("scene_id").distinct().collect() == [("deep/s.tif",)]
    whole = blocks.scan(spark, str(tmp_path))
    assert whole.rdd.getNumPartitions() == 1 and (as_array(whole) == a).all()
    some = blocks.scan(spark, str(tmp_path), 1, rows="5:8", columns="3:4")
    assert some.rdd.getNumPartitions() == 1 and sorted((r["y"], r["samples"]) for r in some.collect()) == [(y, a[y, 3].tolist()) for y in (5, 6, 7)]
    assert (as_array(blocks.scan(spark, str(tmp_path), 1, [2, 0])) == a[:, :, [2, 0]]).all()
    with_joined = spark.sql("SELECT 1").crossJoin(df).filter("frame = 7").collect()
    assert with_joined == []


def test_windows_and_bands_read_fewer_bytes(tmp_path):
    a = np.zeros((40, 10, 3), np.uint8)
    (tmp_path / "a.tif").write_bytes(tiff([a, a], rows=10, planar=True))
    (tmp_path / "b.tif").write_bytes(tiff([a], rows=10))
    full = read_bytes(planned(tmp_path))
    assert full == 3 * a.size
    assert read_bytes(planned(tmp_path, rows="30:")) == full // 4
    assert read_bytes(planned(tmp_path, rows="10:11")) == full // 4
    assert read_bytes(planned(tmp_path, scenes='["b.tif"]')) == a.size
    assert read_bytes(planned(tmp_path, frames="1:2")) == a.size
    assert read_bytes(planned(tmp_path, bands="1")) == 2 * a.size // 3 + a.size
    assert read_bytes(planned(tmp_path, columns=":0")) == 0
    with pytest.raises(ValueError, match="no stretch"):
        planned(tmp_path, rows="7")
    # Of a file that is larger than a split only the directory is read to plan it.
    big = np.zeros((4000, 1000, 1), np.uint8)
    (tmp_path / "big.tif").write_bytes(tiff([big], rows=100))
    with open(tmp_path / "big.tif", "rb") as f:
        ranged = blocks.Ranged(blocks.pa.PythonFile(f, "r"))
        assert len(raster.tiff_blocks(raster.tiff_pages(ranged)[0])) == 40 and ranged.read <= 3 * blocks.HEAD_BYTES


def test_filters_of_one_scan_do_not_meet(spark, tmp_path):
    """With pushed filters Spark would read one of the two twice."""
    for i in range(2):
        (tmp_path / f"{i}.tif").write_bytes(tiff([np.full((64, 8, 1), i, np.uint8)], rows=8))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = blocks.scan(spark, str(tmp_path), split_bytes=1)
    a, b = df.filter("scene_id = '0.tif'"), df.filter("scene_id = '1.tif' AND y < 8")
    assert (a.count(), df.count(), a.union(b).count()) == (512, 1024, 576)
    own = blocks.scan(spark, str(tmp_path), scenes=["1.tif"], rows="3:9", columns=":2")
    assert own.count() == 12 and own.agg(F.min("y"), F.max("y"), F.max("x"), F.min(F.col("samples")[0])).first()[:] == (3, 8, 1, 1.0)


def test_frames_and_small_files_of_a_source(spark, tmp_path):
    a, b = (np.full((4, 3, 1), v, np.uint8) for v in (1, 2))
    for i in range(6):
        (tmp_path / f"{i}.tif").write_bytes(tiff([a, b]))
    rgba = np.arange(4 * 3 * 4).reshape(4, 3, 4).astype(np.uint8)
    (tmp_path / "p.png").write_bytes(raster.png(rgba))
    (tmp_path / "notes.txt").write_text("no raster")
    df = blocks.scan(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 1 and df.count() == 6 * 2 * 12 + 12
    assert (as_array(df.filter("scene_id = '3.tif'"), 1) == b).all() and (as_array(df.filter("scene_id = 'p.png'")) == rgba).all()
    assert blocks.scan(spark, str(tmp_path), 400).rdd.getNumPartitions() > 3
    (tmp_path / "none").mkdir()
    assert blocks.scan(spark, str(tmp_path / "none")).count() == 0


def damaged_files():
    a = np.arange(80, dtype=np.uint8).reshape(8, 10, 1)
    yield "short", tiff([a], rows=2)[:30]
    packed = bytearray(tiff([a], deflate=True, rows=2))
    packed[8:14] = b"\xff" * 6
    yield "deflate", bytes(packed)
    listed = bytearray(tiff([a], rows=2))
    at = listed.index(struct.pack("<HHI", 279, 4, 4)) + 8
    (where,) = struct.unpack_from("<I", listed, at)
    struct.pack_into("<I", listed, where, 10**6)
    yield "sizes", bytes(listed)
    fewer = bytearray(tiff([a], rows=2))
    struct.pack_into("<I", fewer, fewer.index(struct.pack("<HHI", 278, 4, 1)) + 8, 1)
    yield "fewer strips than rows", bytes(fewer)


@pytest.mark.parametrize("name, data", list(damaged_files()))
@pytest.mark.parametrize("split", [1, 1 << 20])
def test_damaged_strips_are_errors(spark, tmp_path, name, data, split):
    with pytest.raises(raster.DamagedRaster):
        raster.decoded(data)
    (tmp_path / "x.tif").write_bytes(data)
    with pytest.raises(PySparkException, match="DamagedRaster"):
        blocks.scan(spark, str(tmp_path), split).collect()


def test_frames_become_channels():
    a, b = (np.full((2, 3, 1), v, np.uint8) for v in (1, 2))
    got, _ = raster.decoded(tiff([a, b]))
    assert got.shape == (2, 3, 2) and got[0, 0].tolist() == [1, 2]


def test_unknown_compression_is_an_error():
    data = bytearray(tiff([np.zeros((2, 2, 1), np.uint8)]))
    at = data.index(struct.pack("<HHI", 259, 3, 1)) + 8
    struct.pack_into("<H", data, at, 5)
    with pytest.raises(raster.UnsupportedRaster):
        raster.decoded(bytes(data))


def test_png_round_trip():
    a = np.random.default_rng(0).integers(0, 256, (6, 5, 4), dtype=np.uint8)
    assert (raster.png_pixels(raster.png(a)) == a).all()


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, value in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.png").write_bytes(raster.png(np.full((2, 2, 4), value, np.uint8)))
    listed = raster.files(spark, str(tmp_path))
    assert {(r["scene_id"], r["metadata"]["filename"]) for r in raster.heads(listed).collect()} == {("a/x.png", "x.png"), ("b/x.png", "x.png")}
    assert {(r["scene_id"], r["y"], r["x"], r["samples"][0]) for r in raster.pixels(listed).collect()} == {(f"{f}/x.png", y, x, v) for f, v in (("a", 1.0), ("b", 2.0)) for y in range(2) for x in range(2)}
    assert raster.files(spark, str(tmp_path / "a" / "x.png")).first()["scene_id"] == "x.png"


def test_pages_in_a_circle():
    head = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<HI", 0, 8)
    with pytest.raises(raster.UnsupportedRaster):
        raster.tiff_pages(head)


def test_scan_metadata_and_uploads(spark, tmp_path):
    a = np.random.default_rng(1).integers(1, 200, (8, 9, 4), dtype=np.uint8)
    (tmp_path / "coast.tif").write_bytes(tiff([a], nodata="0"))
    (tmp_path / "S1_view.png").write_bytes(raster.png(a))
    (tmp_path / "radar_x.tif").write_bytes(tiff([a[:, :, :1]], geo=False))
    (tmp_path / "malicious.exe").write_bytes(b"x")
    (tmp_path / "corrupted.png").write_bytes(b"not a picture")
    listed = raster.files(spark, str(tmp_path))
    good, bad = raster.uploads(listed)
    assert {r["reason"] for r in bad.collect()} == {"extension", "content"} and bad.count() == 2
    assert good.count() == 3 and all(r["id"].startswith("img_") for r in good.collect())
    meta = {r["scene_id"]: r["metadata"] for r in raster.heads(good).collect()}
    m = meta["coast.tif"]
    assert (m["width"], m["height"], m["channels"], m["has_nir"], m["data_type"]) == (9, 8, 4, True, "uint8")
    assert m["crs"].startswith("EPSG:32644") and m["pixel_size_meters"] == 10.0 and m["nodata_value"] == 0.0
    assert m["bounds"]["east"] == pytest.approx(83.218 + 90) and m["modality"] == "MULTISPECTRAL" and m["band_map"]["nir"] == 3
    assert meta["S1_view.png"]["modality"] == "MULTISPECTRAL" and meta["radar_x.tif"]["modality"] == "SAR"
    assert meta["radar_x.tif"]["crs"] is None and meta["radar_x.tif"]["pixel_size_meters"] is None
    px = raster.pixels(good.filter(F.col("path").endswith("coast.tif")))
    assert px.count() == 72
    named = bands.named_bands(px, 4, {"red": 0, "green": 1, "blue": 2, "nir": 3}, nodata=0)
    one = named.filter("y = 3 and x = 4").first()
    assert [one[b] for b in ("red", "green", "blue", "nir")] == a[3, 4].tolist()
    custom = bands.named_bands(px, 4, {"red": 2, "NIR": 9}).filter("y = 0 and x = 0").first()
    assert "nir" not in custom.asDict() and custom["green"] == custom["red"] == a[0, 0, 2]


def test_pictures(spark):
    df = spark.range(12).select(F.lit("s").alias("scene_id"), F.floor(F.col("id") / 4).alias("y"), (F.col("id") % 4).alias("x"), *[F.lit(v).alias(k) for k, v in zip("rgba", (1, 2, 3, 255), strict=True)])
    rows = render.pictures(df, piece=2).collect()
    assert len(rows) == 4 and raster.png_pixels(rows[0]["png"])[0, 0].tolist() == [1, 2, 3, 255]


def test_collections(spark, tmp_path):
    root = str(tmp_path / "none")
    assert not datasets.available(spark, root)
    for read in (datasets.rsvqa, datasets.cdvqa, datasets.vrsbench, datasets.land_cover):
        assert read(spark, root).count() == 0
    (tmp_path / "questions.json").write_text(json.dumps({"questions": [{"id": "1", "image_id": "a", "type": "count", "question": "how many"}, {"id": "2", "image_id": "a", "question": "is there"}]}))
    (tmp_path / "answers.json").write_text(json.dumps({"answers": [{"id": "1", "answer": "3"}, {"id": "1", "answer": "4"}]}))
    (tmp_path / "change_qa.json").write_text(json.dumps({"pairs": {"p": [{"question": "q", "answer": "yes"}]}}))
    (tmp_path / "vrsbench_annotations.json").write_text(json.dumps({"s": {"caption": "x"}}))
    qa = datasets.rsvqa(spark, str(tmp_path)).first()["qa"]
    assert [(r["answer"], r["type"]) for r in qa] == [("4", "count"), ("", "general")]
    assert datasets.cdvqa(spark, str(tmp_path)).first()["qa"][0]["answer"] == "yes"
    assert json.loads(datasets.vrsbench(spark, str(tmp_path)).first()["annotation"]) == {"caption": "x"}
    patch = tmp_path / "cover" / "p1"
    patch.mkdir(parents=True)
    (patch / "p1_labels_metadata.json").write_text(json.dumps({"labels": ["Pastures", "Unknown", "Airports"]}))
    (patch / "p1_B02.tif").write_bytes(tiff([np.zeros((2, 2, 1), np.uint8)]))
    row = datasets.land_cover(spark, str(tmp_path / "cover")).first()
    assert row["labels"] == ["Pastures", "Airports"] and row["files"] == ["p1_B02.tif"]


def test_resolver_and_pairs(spark):
    scenes = spark.createDataFrame([("coast_a.tif", 0), ("coast_b.tif", 1), ("x.tif", 1)], "name string, source int")
    wanted = spark.createDataFrame([("coast",), ("x",), ("",), ("old",), ("gone",)], "identifier string")
    got = {r["identifier"]: r["name"] for r in datasets.resolve(scenes, wanted, {"old": "x.tif"}).collect()}
    assert got == {"coast": "coast_a.tif", "x": "x.tif", "old": "x.tif", "gone": None}
    assert datasets.pairs(datasets.samples(spark)).count() == 4


def test_store(spark, tmp_path):
    path = str(tmp_path / "analyses")
    rows = [{f.name: None for f in RESULT} | {"analysis_id": f"a{i}", "execution_time_ms": float(i) if i else None} for i in range(25)]
    store.save(spark.createDataFrame(rows, RESULT), path)
    store.save(spark.createDataFrame(rows[:1], RESULT), path)
    kept = store.load(spark, path)
    assert kept.count() == 26 and store.lookup(kept, "a3").count() == 1
    assert [r["analysis_id"] for r in store.recent(kept).collect()][:2] == ["a24", "a23"] and store.recent(kept).count() == 20
    assert json.loads(store.dossier(store.lookup(kept, "a3")).first()["dossier"]) is not None
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "ok.json").write_text(json.dumps({"analysis_id": "z"}))
    (tmp_path / "j" / "bad.json").write_text("{")
    assert [r["analysis_id"] for r in store.bootstrap(spark, str(tmp_path / "j")).collect()] == ["z"]


def test_stream_ingest(spark, tmp_path):
    from quadrille.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(raster.png(np.zeros((2, 2, 4), np.uint8)))
    (tmp_path / "in" / "b.exe").write_bytes(b"x")
    q = ingest(spark, str(tmp_path / "in"), str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 and spark.read.parquet(str(tmp_path / "no")).count() == 1


def test_jpeg_has_no_decoder_here():
    with pytest.raises((raster.UnsupportedRaster, PySparkException)):
        raster.decoded(b"\xff\xd8\xff")


def scanned_rows(df) -> int:
    """Rows that the file scan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return sum(plan.collectLeaves().apply(i).metrics().apply("numOutputRows").value() for i in range(plan.collectLeaves().size()))


def test_saves_can_be_repeated_and_look_ups_prune(spark, tmp_path):
    path = str(tmp_path / "kept")
    empty = {f.name: None for f in RESULT}
    ids = [f"ans_{(i * 2654435761) % 2**32:08x}" for i in range(60_000)]
    rows = spark.createDataFrame([tuple((empty | {"analysis_id": i}).values()) for i in ids], RESULT)
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(64 << 10))
    try:
        store.save(rows.coalesce(1), path, "first", "2026-01-01", 60_000)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    store.save(rows.limit(5), path, "second", "2026-01-02")
    store.save(rows.limit(5), path, "second", "2026-01-02")
    kept = store.load(spark, path)
    assert kept.count() == 60_005 and kept.filter("run = 'second'").count() == 5
    one = store.lookup(kept.filter("run = 'first'"), ids[777])
    assert one.count() == 1 and 1 <= scanned_rows(one) < 30_000, "row groups without the id are passed over"
    none = store.lookup(kept, "ans_ffffffff0", "2026-01-02")
    assert none.count() == 0 and scanned_rows(none) == 0


def test_names_are_found_by_trigrams(spark):
    names = ["coast.tif", "cost_coast.tif", "a", "ab", "abc", "Straße.tif", "", "aXa", "tif"]
    scenes = spark.createDataFrame([(n, i % 2) for i, n in enumerate(names)], "name string, source int")
    wanted = ["coast", "st", "a", "tif", "aXa", "ß", "none at all", "", "b", "abcd", "t_c", ".ti", "coast.tif"]
    df = datasets.resolve(scenes, spark.createDataFrame([(w,) for w in wanted], "identifier string"), {"abcd": "abc"})
    want = {w: min(((i % 2, n) for i, n in enumerate(names) if w in n), default=(0, "abc" if w == "abcd" else None))[1] for w in wanted if w}
    assert {r["identifier"]: r["name"] for r in df.collect()} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("few", [0, 1000])
def test_names_meet_identifiers_by_equality(spark, few):
    """Letters that all names share cost no meeting of each name with each identifier."""
    names = [(f"Customer#{i % 700:09d}", None if i % 3 == 0 else i % 2) for i in range(2000)]
    wanted = [*(f"{i:04d}" for i in range(0, 1200, 7)), *(f"{i:02d}" for i in range(100)), "er#0", "Customer#000000123", "ü"]
    df = datasets.resolve(spark.createDataFrame(names, "name string, source int"), spark.createDataFrame([(w,) for w in wanted], "identifier string"), few=few)
    want = {w: min(((s is None, s or 0, n) for n, s in names if w in n), default=(0, 0, None))[2] for w in wanted}
    assert dict(df.collect()) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Contains(" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_uploads_of_a_stream_can_be_decoded(spark, tmp_path):
    """Arrive, be judged, be kept, and be read as pixels."""
    from quadrille.streaming.ingest import ingest

    (tmp_path / "in" / "deep").mkdir(parents=True)
    a = np.arange(24, dtype=np.uint8).reshape(4, 6, 1)
    (tmp_path / "in" / "deep" / "x.tif").write_bytes(tiff([a]))
    (tmp_path / "in" / "y.png").write_bytes(b"not a picture")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "taken"), str(tmp_path / "refused"), str(tmp_path / "state")).awaitTermination()
    taken = spark.read.parquet(str(tmp_path / "taken"))
    assert [r["scene_id"] for r in raster.heads(taken).collect()] == ["deep/x.tif"]
    got = {(r["y"], r["x"]): r["samples"] for r in raster.pixels(taken).collect()}
    assert got == {(y, x): [float(a[y, x, 0])] for y in range(4) for x in range(6)}
    assert spark.read.parquet(str(tmp_path / "refused")).count() == 1
