"""Saved feeds by name, as a batch and as a stream."""

from wordweave.session import ship
from wordweave.sources.feeds import SavedFeeds, titles
from wordweave.streaming import streams


def save(path, name, body):
    (path / name).write_bytes(body if isinstance(body, bytes) else body.encode())


def test_titles():
    assert titles("<title>own</title><title>A &amp;amp; <b>B</b></title><TITLE>no</TITLE><title>&#233;&#x41;&nope;</title>") == ["A &amp; B", "éA&nope;"]
    assert titles("") == titles("<title>own</title>") == []


def test_batch_and_stream(spark, tmp_path):
    ship(spark).dataSource.register(SavedFeeds)
    feeds, sink = tmp_path / "feeds", f"{tmp_path}/out"
    feeds.mkdir()
    assert spark.read.format("saved_feeds").load(str(feeds)).count() == 0
    save(feeds, "001.xml", "<title>own</title><title>One</title>\n<title>Two</title>")
    save(feeds, "002.xml", b"\xff\xfe broken <title>x")
    save(feeds, "003.xml", "<title>own</title><title>Three &lt;3</title>")
    save(feeds, "_hidden.xml", "<title>own</title><title>no</title>")
    want = {("001", 1, "One"), ("001", 2, "Two"), ("003", 1, "Three <3")}
    rows = lambda n: spark.read.format("saved_feeds").option("partitions", n).load(str(feeds))
    for n in (1, 2, 8):
        assert {tuple(r) for r in rows(n).collect()} == want
    assert rows(2).rdd.getNumPartitions() == 2
    assert spark.read.format("saved_feeds").load(str(tmp_path / "gone")).count() == 0
    stream = lambda: spark.readStream.format("saved_feeds").load(str(feeds))

    def run():  # a source of one's own takes its data in batches of a trigger
        query = streams.appended(stream(), sink, every="1 second")
        query.processAllAvailable()
        query.stop()
        return {(r.feed, r.pos, r.title) for r in spark.read.parquet(sink).collect()}

    assert run() == want
    save(feeds, "004.xml", "<title>own</title><title>Four</title>")
    assert run() == want | {("004", 1, "Four")}
    assert spark.read.parquet(sink).count() == 4
