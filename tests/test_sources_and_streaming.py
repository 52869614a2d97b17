import json

from pyspark.sql import functions as F

from pagequarry.sources import io
from pagequarry.streaming import pages as S


def test_files_and_charsets(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("é".encode("latin-1"))
    (tmp_path / "b.html").write_bytes(b"\xff\xfe" + "ü".encode("utf-16-le"))
    assert {r.html for r in io.read_files(spark, str(tmp_path), "latin1").collect()} == {"é", "ü"}
    rows = spark.createDataFrame([(bytearray(b"\x80"),), (bytearray(b"\xe2\x82"),)], "b binary")
    assert [r.t for r in rows.select(io.decode_bytes(F.col("b"), "windows-1252").alias("t")).collect()] == ["€", "â‚"]
    assert rows.select(io.decode_bytes(F.col("b")).alias("t")).first().t == "�"


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", bytearray(b"\0\1"))], "doc_id long, content string, data binary")
    io.write_json_lines(rows, str(tmp_path / "out"), with_content=False)
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"doc_id": 1, "content": None, "data": "AAE="}]


def test_stream_of_pages(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, f"http://h/{k}", f"<h1>t{k}</h1>")], S.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.read_pages(spark, str(tmp_path / "in"), files_per_batch=2)
    query = S.convert_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.content for r in out.collect()) == ["# t0\n", "# t1\n", "# t2\n"]


def test_windows_and_crawls(spark, tmp_path):
    rows = [(1, "http://h/1", "xx", "2024-01-01 00:01:00"), (2, "http://h/1", "xx", "2024-01-01 00:02:00"), (3, "http://g/", "yyy", "2024-01-01 00:30:00")]
    spark.createDataFrame(rows, "page_id long, url string, html string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("page_id long, url string, html string, at timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("crawls", S.first_crawls(stream, "at"), "append"), ("windows", S.pages_per_window(stream, "at"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("crawls").count() == 2
    assert sorted((r.host, r.n_pages, r.n_chars) for r in spark.table("windows").collect()) == [("g", 1, 3), ("h", 2, 4)]
