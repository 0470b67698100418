"""Row-wise steps give the same rows on a stream as in batch."""

from shelfwise.operators.products import clean_lines, label_lines, with_date_features
from shelfwise.sources.tables import write_table
from shelfwise.streaming.rowwise import clean_line_stream, read_line_stream
from tests.test_tables import raw


def test_stream_matches_batch(spark, tmp_path):
    folder = str(tmp_path / "lines")
    write_table(raw(spark), folder, "csv", ";")
    mapping = spark.createDataFrame([("10 red valve", "A")], "OBITNO string, category string")
    out = clean_line_stream(read_line_stream(spark, folder), mapping)
    q = out.writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    cols = [c for c in spark.table("cleaned").columns if c != "description_clean"]
    batch = with_date_features(clean_lines(label_lines(raw(spark), mapping), False)).select(*cols)
    assert sorted(map(str, spark.table("cleaned").select(*cols).collect())) == sorted(map(str, batch.collect()))
