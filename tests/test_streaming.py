import datetime

from sheetloom.streaming import pages


def test_pages_are_scored_and_counted_as_they_come(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12, 3)
    rows = [("f", 1, "FEATURES of a sensor", at), ("f", 2, "x", at)]
    spark.createDataFrame(rows, "source_file string, page_number int, text string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = pages.read_pages(spark, str(tmp_path / "in"))
    for name, df, mode in (("scored_pages", pages.scored(stream), "append"), ("counted_pages", pages.pages_by_window(stream), "complete")):
        job = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        job.awaitTermination(60)
    assert spark.table("scored_pages").count() == 2
    assert [(r.pages, r.chars) for r in spark.table("counted_pages").collect()] == [(2, 21)]
