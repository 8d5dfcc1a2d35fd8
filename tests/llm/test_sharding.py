from collections import Counter

from quadrille.llm.sharding import assign_shards, op1_sharding, slots

DATA = "/root/testdata/sf0.001"


def plain(key: int, shards: int) -> int:
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_as_published_and_grown(spark):
    rows = [(i, "t") for i in (*range(500), -1, -(1 << 63), (1 << 63) - 1)] + [(None, None)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert r["shard"] == plain(r["doc_id"] or 0, 16) and r["grown_shard"] == plain(r["doc_id"] or 0, 17)
        assert r["grown_shard"] in (r["shard"], 16)


def test_slots_are_gapless(spark, make):
    df = make([(i % 40, "same") for i in range(400)] + [(None, None)])
    got = slots(assign_shards(df, grown=None), ["doc_id"], blocks=4).collect()
    shards = Counter(r["shard"] for r in got)
    assert sum(shards.values()) == 401
    for s, n in shards.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert assign_shards(df.limit(0)).count() == 0


def test_query(spark):
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op1_sharding(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        b = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 1, zlib.crc32(b), "key") and r["shard"] == plain(r["doc_id"], 16)
