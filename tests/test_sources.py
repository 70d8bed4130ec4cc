import gzip
import json

from pyspark.sql import functions as F

from hydrostrata.sources import files
from hydrostrata.streaming import cycles


def test_files(spark, tmp_path):
    (tmp_path / "raw/2023").mkdir(parents=True)
    with gzip.open(tmp_path / "raw/2023/a.json.gz", "wt") as f:
        json.dump({"x": [1, 2]}, f, indent=1)
    row = files.json_documents(spark, f"{tmp_path}/raw/*/*.json.gz").first()
    assert row.year == "2023" and json.loads(row.body) == {"x": [1, 2]}
    stored = files.manifest(spark, f"{tmp_path}/raw/*/*").cache()
    assert stored.count() == 1 and files.verify_manifest(spark, f"{tmp_path}/raw/*/*", stored).count() == 0
    (tmp_path / "raw/2023/b.json.gz").write_bytes(b"x")
    assert [tuple(r) for r in files.verify_manifest(spark, f"{tmp_path}/raw/*/*", stored).collect()] == [("2023/b.json.gz", "new")]
    df = spark.createDataFrame([(1, 'a "q", b', "dev"), (2, None, "test")], "id int, t string, split string")
    files.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, files.csv(spark, f"{tmp_path}/c", df.schema).collect())) == sorted(map(tuple, df.collect()))
    files.write_json_lines(df, f"{tmp_path}/j", "split")
    assert files.json_lines(spark, f"{tmp_path}/j").count() == 2
    for _ in range(2):
        files.append_new(df, f"{tmp_path}/p", "id")
    files.append_new(df.withColumn("id", F.col("id") + 1), f"{tmp_path}/p", "id")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [1, 2, 3]
    assert files.as_csv_text(df.select("id")).split() == ["id", "1", "2"]


def test_streams(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, i, f"2024-01-0{i + 1} 0{k}:00:00") for k in range(3)], "k int, v int, at string").withColumn("ts", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = "k int, v int, at string, ts timestamp"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    cycles.upsert_batches(stream, "k", "v", f"{tmp_path}/out", f"{tmp_path}/cp")()
    last = spark.read.parquet(f"{tmp_path}/out/version=2")
    assert sorted((r.k, r.v) for r in last.collect()) == [(0, 2), (1, 2), (2, 2)]
    events = cycles.event_stream(spark, f"{tmp_path}/in/*", schema)
    query = cycles.windowed(events, "ts", "k", "v", "1 day").writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").count() >= 3
