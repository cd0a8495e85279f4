from rankfold import schema as sc
from rankfold.sources.boards import board_a_postings
from rankfold.sources.lists import markdown_postings
from rankfold.streaming.landing import append_postings, stream_landed

PAYLOAD = '{"jobs": [{"title": "Developer", "content": "&lt;p&gt;x&lt;/p&gt;"}, {"title": "Manager"}]}'


def test_newly_landed_payloads_are_appended_once(spark, tmp_path, collect):
    landed, out, progress = (str(tmp_path / n) for n in ("landed", "out", "progress"))

    def land(slug):
        spark.createDataFrame([(slug, 0, PAYLOAD)], sc.PAYLOADS_SCHEMA).write.mode("append").parquet(landed)

    def run():
        postings = board_a_postings(stream_landed(spark, "board_a", landed, files_per_trigger=1), 0)
        append_postings(postings, out, progress).awaitTermination(120)

    land("one")
    run()
    land("two")
    run()
    run()
    assert collect(spark.read.parquet(out), "company", "description") == [("one", "x"), ("two", "x")]


def test_list_parsing_accepts_a_stream(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([("md", 0, "| a | b | c | [x](https://x.example) |")], sc.RAW_DOCS_SCHEMA).write.parquet(path)
    assert markdown_postings(stream_landed(spark, "raw_docs", path), ("source",)).isStreaming
