"""The archive: exact URLs, payloads of very many records."""

from strandline.llm import warc


def test_urls_come_back_exactly(spark):
    urls = ["http://a/b?c=%0A", "line\r\nbreak\n", "", None, " spaces ", "\u00fc\r"]
    df = spark.createDataFrame([(i, u, "x" * 120) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r.url for r in warc.read_index(spark, warc.write_archive(df)).collect()}
    assert got == dict(enumerate(urls))


def test_payload_of_many_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "MANY", 10)
    df = spark.createDataFrame([(i, f"u{i}", "y" * 150 if i % 3 else f"own {i}") for i in range(200)], "page_id long, url string, html string")
    folder = warc.write_archive(df)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.records(spark, folder).collect()}
    assert got == {i: "y" * 150 if i % 3 else f"own {i}" for i in range(200)}
    monkeypatch.setattr(warc, "BROADCAST", 0)
    assert warc.read_index(spark, folder).where("record_type = 'revisit' AND refers_to = 1").count() == 132
