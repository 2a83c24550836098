"""Filings as a table and as a stream: what is opened, and what is seen again."""

import os

from pyspark.sql import functions as F

from corpusloom.sources import filings_source, store


def write(folder, name, text, time):
    at = folder / name
    at.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(at, ns=(time * 10**9, time * 10**9))


def test_batch(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "below").mkdir(parents=True)
    for k in range(6):
        write(folder, f"f{k}.html", f"<p>{k}</p>" * (k + 1), 100 + k)
    write(folder, "odd.html", b"\x93x", 50)
    write(folder, "other.txt", "no", 1)
    write(folder / "below", "deep.html", "no", 1)
    filings_source.register(spark)
    df = spark.read.format("filings").option("partition_bytes", 30).load(str(folder))
    got = {r.source_file: r.html for r in df.collect()}
    assert got == {r.source_file: r.html for r in store.read_html(spark, str(folder)).collect()} and len(got) == 7 and got["odd.html"] == "“x"
    assert df.rdd.getNumPartitions() > 3
    # a condition on the name is met by the listing: what can't be opened isn't
    os.chmod(folder / "f5.html", 0)
    (folder / "f4.html").unlink()
    (folder / "f4.html").symlink_to(folder / "f3.html")
    some = df.where("source_file in ('f1.html', 'f2.html') or source_file = 'none'")
    assert sorted(r.source_file for r in some.collect()) == ["f1.html", "f2.html"]
    one = df.where(F.col("source_file") == "f1.html")
    assert one.rdd.getNumPartitions() == 1 and one.select("length").first()[0] == 16
    assert df.where("source_file like 'f0%'").count() == 1 and df.where("length > 10 and source_file = 'f0.html'").count() == 0


def test_stream_agrees_with_batch_and_starts_again(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    filings_source.register(spark)

    def run():
        seen = spark.readStream.format("filings").load(str(folder)).select("source_file", "html")
        seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.source_file, r.html) for r in spark.read.schema("source_file string, html string").parquet(out).collect())

    write(folder, "a.html", "one", 100)
    write(folder, "b.html", "two", 100)
    assert run() == [("a.html", "one"), ("b.html", "two")]
    assert run() == [("a.html", "one"), ("b.html", "two")]  # a new query over the old checkpoint sees nothing again
    write(folder, "c.html", "three", 100)  # the same time, a later name
    write(folder, "a.html", "changed", 200)
    want = [("a.html", "changed"), ("a.html", "one"), ("b.html", "two"), ("c.html", "three")]
    assert run() == want == run()
    last = {r.source_file: r.html for r in spark.read.format("filings").load(str(folder)).collect()}
    assert last == {"a.html": "changed", "b.html": "two", "c.html": "three"} and set(last.items()) <= set(want)


def test_parsed_documents_are_written_as_files(spark, tmp_path):
    import json

    from corpusloom.operators import filings

    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "aapl-2024.html", "<TYPE>10-K\n<FILENAME>aapl-2024.htm\n<p>Item 1A. Risk Factors</p><p>One two</p><p>Item 1B. Unresolved</p>", 100)
    write(tmp_path / "in", "zz-10Q.html", "nothing", 100)
    docs = filings.parse(store.read_html(spark, str(tmp_path / "in")))
    assert store.write_json_files(docs, str(tmp_path / "parsed")) == 2
    one, two = (json.loads((tmp_path / "parsed" / f"{n}.json").read_text()) for n in ("aapl-2024", "zz-10Q"))
    assert list(one) == ["source_file", "ticker", "filing_type", "fiscal_period", "filename", "warnings", "sections"]
    assert (one["ticker"], one["filing_type"], one["fiscal_period"], [s["section"] for s in one["sections"]]) == ("aapl", "10-K", None, ["Item 1A Risk Factors"])
    assert one["sections"][0]["text"].endswith("One two") and one["sections"][0]["word_count"] == 6 and len(one["warnings"]) == 1
    assert (two["ticker"], two["filing_type"], two["sections"], len(two["warnings"])) == ("zz", "10Q", [], 2)
