import hashlib
import math
import zlib

from ragspark.llm import sharding


def chosen(key, n):
    draws = [int(hashlib.md5(f"{'null' if key is None else key}:{s}".encode()).hexdigest()[:13], 16) for s in range(n)]
    return draws.index(max(draws))


def placed(spark, docs, rows, **kw):
    from pyspark.sql import functions as F

    df = docs(rows, **kw).select("doc_id", F.octet_length("text").alias("size"))
    return sharding.assign_shards(df, "doc_id", sharding.equal_shards(24), sharding.equal_shards(25), ["size"]).collect()


def test_matches_brute_force_and_slots_have_no_gaps(spark, docs):
    rows = [(i, "x" * (i % 7)) for i in range(500)] + [(None, None), (None, ""), (7, "x")]
    got = placed(spark, docs, rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["shard"] == chosen(r["doc_id"], 24) and r["grown_shard"] == chosen(r["doc_id"], 25)
        assert r["grown_shard"] in (r["shard"], 24)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_weights_share_the_records(spark):
    from pyspark.sql import functions as F

    shard = sharding.rendezvous_shard(F.col("id"), [(0, 1.0), (1, 3.0)])
    n = spark.range(4000).select(shard.alias("s")).filter("s = 1").count()
    assert abs(n / 4000 - 0.75) < 0.03


def test_empty_table_and_one_hot_key(spark, docs):
    assert placed(spark, docs, []) == []
    hot = placed(spark, docs, [(5, "a")] * 300)
    assert sorted(r["slot"] for r in hot) == list(range(300)) and len({r["shard"] for r in hot}) == 1


def test_query_columns(spark, tmp_path, docs, clashes):
    docs([(1, "é"), (2, None), (3, "")], extra={k: v for k, v in clashes.items() if k != "shard"}).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in sharding.op1_sharding(spark, str(tmp_path)).collect()}
    assert [got[i]["size"] for i in (1, 2, 3)] == [10, 8, 8]
    assert got[1]["text_crc32"] == zlib.crc32("é".encode()) and got[2]["text_crc32"] == 0
    assert not math.isnan(got[1]["slot"])
