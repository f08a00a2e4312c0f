"""Archive, sinks, incremental views and streams; a stream must give what a batch gives."""

import random

import pytest
from pyspark.sql import functions as F

from poolscope import schemas
from poolscope.operators import checks, decode, history
from poolscope.sources import archive
from poolscope.streaming import views

NS = 10**9


def blocks(spark, heights):
    event = lambda kind: (kind, [("k", "v")])
    return spark.createDataFrame([(h, h * NS, f"hash{h}", [event("b")], [([event("t1"), event("t2")],)], [event("e")]) for h in heights], schemas.BLOCK)


def test_archive(spark, tmp_path):
    path = str(tmp_path / "blocks")
    archive.write_blocks(blocks(spark, range(1, 26)), path, per_chunk=10)
    read = archive.read_blocks(spark, path, 8, 21, per_chunk=10)
    assert sorted(r["height"] for r in read.collect()) == list(range(8, 22))
    assert "PartitionFilters: [isnotnull(height_chunk" in read._jdf.queryExecution().toString()
    events = decode.flatten_blocks(read)
    assert events.count() == 14 * 4 and [r["type"] for r in events.filter("height = 9").orderBy("event_idx").collect()] == ["b", "t1", "t2", "e"]
    assert archive.chunk_hashes(spark, path).filter("length(sha256) = 64").count() >= 3
    both = archive.combined(archive.read_blocks(spark, path), blocks(spark, range(20, 30)))
    assert sorted(r["height"] for r in both.collect()) == list(range(1, 30)) and archive.resume_height(both) == 30
    assert checks.missing_heights(both.filter("height <> 7")).first()["height"] == 6


def test_small_chunks_share_files_and_have_hashes_of_their_own(spark, tmp_path):
    hashes = lambda path: {r["name"]: r["sha256"] for r in archive.chunk_hashes(spark, str(tmp_path / path)).collect()}
    some = blocks(spark, range(1, 500))
    archive.write_blocks(some, str(tmp_path / "one"), per_chunk=10)
    archive.write_blocks(some.filter("height % 2 = 0"), str(tmp_path / "two"), per_chunk=10)
    archive.write_blocks(some.filter("height % 2 = 1").repartition(3), str(tmp_path / "two"), per_chunk=10)
    archive.write_blocks(some.withColumn("hash", F.when(F.col("height") == 33, "other").otherwise(F.col("hash"))).filter("height <> 77"), str(tmp_path / "bad"), per_chunk=10)
    assert len(list((tmp_path / "one").glob("*/*.parquet"))) == 1
    whole = hashes("one")
    assert len(whole) == len(set(whole.values())) == 50 and hashes("two") == whole
    published = spark.createDataFrame([*whole.items(), ("height_chunk=510", "11")], "name string, sha256 string")
    wrong = archive.wrong_chunks(archive.chunk_hashes(spark, str(tmp_path / "bad")), published)
    assert {r["name"]: r["sha256"] is None for r in wrong.collect()} == {"height_chunk=40": False, "height_chunk=80": False, "height_chunk=510": True}
    read = archive.read_blocks(spark, str(tmp_path / "two"), 95, 310, per_chunk=10)
    assert sorted(r["height"] for r in read.select("height").collect()) == list(range(95, 311))


def test_tables(spark, tmp_path):
    path, day = str(tmp_path / "tables"), 86400 * NS
    rows = spark.createDataFrame([("p", k, 0, k * day + 5) for k in range(5)], schemas.table_schema("rewards_event_entries"))
    archive.write_tables({"rewards_event_entries": rows}, path)
    got = archive.read_table(spark, path, "rewards_event_entries", day, 3 * day)
    assert sorted(r["rune_e8"] for r in got.collect()) == [1, 2]
    assert archive.api_json(rows.limit(1)).first()["value"] == '{"pool":"p","rune_e8":"0","event_idx":"0","block_timestamp":"5"}'
    archive.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 5
    spark.createDataFrame([("old",)], "schema_hash string").write.mode("overwrite").parquet(f"{path}/_schema")
    with pytest.raises(ValueError):
        archive.read_table(spark, path, "rewards_event_entries")


def test_watermarked_view(spark, tmp_path):
    source = spark.createDataFrame([(f"p{k % 3}", k, k * NS) for k in range(40)], "pool string, v long, block_timestamp long")
    build = lambda df: df.withColumn("w", F.col("v") * 2)
    view = views.WatermarkedView(spark, str(tmp_path / "view"), build)
    want = sorted(map(str, build(source).collect()))
    for until in (0, 11 * NS, 11 * NS, 30 * NS):
        view.refresh(source, until)
        assert sorted(map(str, view.read(source).select("pool", "v", "block_timestamp", "w").collect())) == want
    assert view.watermark() == 30 * NS
    with pytest.raises(ValueError):
        view.refresh(source, 5)


def test_rollup_refresh(spark, tmp_path):
    path, day = str(tmp_path / "rollup"), 86400 * NS
    rng = random.Random(2)
    rows = [("p", rng.randrange(99), k, rng.randrange(4 * day)) for k in range(400)]
    agg = history.Aggregate("a", ["pool"]).sum("v").last("newest", F.col("v"))
    df = spark.createDataFrame(rows, "pool string, v long, event_idx long, block_timestamp long")
    views.refresh_rollup(df.filter(F.col("block_timestamp") < 2 * day), agg, path)
    views.refresh_rollup(df, agg, path, changed_from_ns=day + 7)
    stored = spark.read.parquet(path).drop("day")
    for interval in ("5min", "day", "month"):
        got = agg.final(views.coarser(stored, agg, interval))
        assert sorted(map(str, got.collect())) == sorted(map(str, agg.final(agg.rollup(df, interval)).collect()))


def events(spark, n=60):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        kind = rng.choice(["add_liquidity", "rewards"])
        pairs = [("BTC.BTC", str(rng.randrange(50))), ("ETH.ETH", "3"), ("bond_reward", "1")] if kind == "rewards" else [("pool", "BTC.BTC"), ("rune_amount", str(k)), ("asset_amount", "2")]
        rows.append((k // 3, k * NS, k % 3, kind, pairs))
    return spark.createDataFrame(rows, "height long, block_timestamp long, event_idx long, type string, attributes array<struct<key:string,value:string>>")


def test_pool_stream_equals_batch(spark, tmp_path):
    df, path = events(spark), str(tmp_path / "in")
    df.filter("height < 8").coalesce(1).write.parquet(path)
    stream = lambda: spark.readStream.schema(df.schema).parquet(path)
    latest = {}

    def keep(batch, epoch):
        latest.update({r["pool"]: tuple(r) for r in batch.collect()})

    def run():
        query = views.pool_stats_stream(views.pool_events(stream())).writeStream.outputMode("update").foreachBatch(keep)
        query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    run()
    df.filter("height >= 6").coalesce(1).write.mode("append").parquet(path)  # heights 6 and 7 come twice
    run()
    want = {r["pool"]: tuple(r) for r in views.pool_stats_batch(views.pool_events(df)).collect()}
    assert latest == want
    assert views.kind_totals(views.pool_events(df)).count() == 2


def test_tables_from_a_stream(spark, tmp_path):
    df, path, out = events(spark), str(tmp_path / "in"), str(tmp_path / "out")
    df.coalesce(1).write.parquet(path)
    query = views.stream_tables(spark.readStream.schema(df.schema).parquet(path), {"rewards_events": views.append_once(out)}, str(tmp_path / "check"), decode.decode_all)
    query.awaitTermination()
    assert spark.read.parquet(out).count() == df.filter("type = 'rewards'").count()
    pushed = []
    depth = df.select(F.lit("p").alias("pool"), F.col("height").alias("asset_e8"), (F.col("height") * 2).alias("rune_e8"), "block_timestamp")
    depth.coalesce(1).write.parquet(str(tmp_path / "depths"))
    stream = spark.readStream.schema(depth.schema).parquet(str(tmp_path / "depths"))
    views.price_updates(stream, pushed.extend, str(tmp_path / "check2")).awaitTermination()
    assert pushed == [("p", 2.0)]
