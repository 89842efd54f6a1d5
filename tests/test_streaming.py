import pytest
from pyspark.sql import functions as F

from cedarlog.functions.mask import leaks
from cedarlog.operators.retrieval import embed, to_documents
from cedarlog.plans.ingest import structure, with_signatures
from cedarlog.sources.lines import stream_lines
from cedarlog.streaming.ingest import dual_sink, start_ingest, streaming_error_rate

NOW = "2025-12-01 00:00:00"
SEVEN = [
    "2025-03-02 06:15:00 INFO tide-gauge: Water level at pier=7 metres=1.84",
    "2025-03-02 06:15:20 WARN lock-keeper: Gate slow to close chamber=2 seconds=95",
    "2025-03-02 06:15:40 ERROR radio-desk: Call from 172.16.4.9 was cut off after 12 words",
    "2025-03-02 06:16:00 INFO berth-plan: Plan sent to captain.ines@harbour.example and 10.8.0.77",
    "2025-03-02 06:16:20 INFO harbour-dues: Dues taken from card 6011 0009 9013 9424 for berth=31",
    "2025-03-02 06:16:40 ERROR lock-keeper: Gate jammed chamber=2 after tries=3",
    "2025-03-02 06:17:00 INFO tide-gauge: Water level at pier=8 metres=1.79",
]


def run(spark, folder, out):
    job = start_ingest(
        stream_lines(spark, str(folder), files_per_batch=1), f"{out}/logs", f"{out}/state", 2025, NOW, f"{out}/docs"
    )
    job.awaitTermination()


def test_stream_fills_both_sinks_once(spark, tmp_path):
    folder = tmp_path / "zone"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(SEVEN[:4]))
    (folder / "b.log").write_text("\n".join(SEVEN[4:]))
    run(spark, folder, tmp_path)
    run(spark, folder, tmp_path)
    logs = spark.read.parquet(f"{tmp_path}/logs")
    assert logs.count() == 7 and logs.select("service_name").distinct().count() == 5
    assert logs.filter(leaks(F.col("message")) | leaks(F.col("context"))).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert docs.count() == 7 and docs.filter(leaks(F.col("text"))).count() == 0
    (folder / "c.log").write_text(SEVEN[0])
    run(spark, folder, tmp_path)
    assert spark.read.parquet(f"{tmp_path}/logs").count() == 8


def test_repeated_batch_adds_nothing(spark, tmp_path):
    df = with_signatures(structure(spark.createDataFrame([(x,) for x in SEVEN], "value string"), 2025, NOW))
    write = dual_sink(f"{tmp_path}/logs", f"{tmp_path}/docs")
    for _ in range(2):
        write(df, 3)
    assert spark.read.parquet(f"{tmp_path}/logs").count() == 7
    assert spark.read.parquet(f"{tmp_path}/docs").count() == 7


def test_rate_emits_closed_periods_only(spark, tmp_path):
    rows = [("2025-03-02 10:10:00", "ERROR"), ("2025-03-02 10:20:00", "INFO"), ("2025-03-02 15:00:00", "INFO")]
    df = spark.createDataFrame(rows, "t string, severity string")
    df.select(F.to_timestamp("t").alias("timestamp"), "severity").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("timestamp timestamp, severity string").parquet(f"{tmp_path}/in")
    job = (
        streaming_error_rate(source).writeStream.format("memory").queryName("rates").outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    (r,) = spark.table("rates").collect()
    assert (r.n, r.errors, r.rate) == (2, 1, 0.5)


def test_documents_come_from_the_stored_rows(spark, tmp_path, monkeypatch):
    """A batch is neither kept in memory nor parsed twice."""
    df = with_signatures(structure(spark.createDataFrame([(x,) for x in SEVEN], "value string"), 2025, NOW))
    monkeypatch.setattr(type(df), "persist", lambda *_: pytest.fail("a batch may be as large as the input"))
    dual_sink(f"{tmp_path}/logs", f"{tmp_path}/docs")(df, 0)
    want = embed(to_documents(spark.read.parquet(f"{tmp_path}/logs"))).select("doc_key", "text", "embedding").collect()
    got = spark.read.parquet(f"{tmp_path}/docs").select("doc_key", "text", "embedding").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 7
    dual_sink(f"{tmp_path}/logs", f"{tmp_path}/docs")(df.limit(0), 1)
    assert spark.read.parquet(f"{tmp_path}/docs").count() == 7
