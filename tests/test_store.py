"""The chunk store's snapshots: what readers and writers see of each other."""

import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.jobs import queries
from corpusloom.sources import store
from corpusloom.sources.snapshots import Conflict, Snapshots, fingerprint

_CHUNK = "source_file string, ticker string, filing_type string, fiscal_period string, section string, chunk_index int, char_offset int, content string, embedding array<float>"


def rows(spark, *docs):
    return store.store_rows(spark.createDataFrame([(d, "t", "10-K", None, "s", k, 3 * k, text, [1.0, 0.0]) for d, k, text in docs], _CHUNK))


def held(df):
    return sorted(((r.source_doc, r.content) for r in df.collect()), key=str)


def test_a_writer_that_dies_and_a_reader_between(spark, tmp_path):
    at = str(tmp_path)
    store.init_store(spark, at, 2)
    store.seed(rows(spark, ("f", 0, "one"), ("f", 1, "two"), ("g", 0, "x")), at)
    before = store.read_store(spark, at)
    assert held(before) == [("f", "one"), ("f", "two"), ("g", "x")]
    # dies when half of its rows are written
    half = rows(spark, *((f"d{i}", 0, "t") for i in range(50)), ("f", 0, "lost")).repartition(10)
    dying = half.withColumn("content", F.when(F.col("source_doc") == "d40", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="killed"):
        store.seed(dying, at)
    assert held(store.read_store(spark, at)) == held(before)
    # a reader keeps what it opened while others replace, delete and compact
    version = store.seed(rows(spark, ("f", 0, "new")), at, spark.createDataFrame([("g",)], "source_doc string"))
    assert held(store.read_store(spark, at)) == [("f", "new")] and held(before) == [("f", "one"), ("f", "two"), ("g", "x")]
    assert store.compact(spark, at)
    store.append(rows(spark, ("f", 1, "more")), at)
    assert held(store.read_store(spark, at)) == [("f", "more"), ("f", "new")] and held(store.read_store(spark, at, version)) == [("f", "new")]
    assert held(before) == [("f", "one"), ("f", "two"), ("g", "x")]
    # nothing that is in hand goes; later all that no kept snapshot names does
    assert store.vacuum(spark, at) == []
    gone = store.vacuum(spark, at, keep=1, older_than=0)
    assert len(gone) >= 4 and held(store.read_store(spark, at)) == [("f", "more"), ("f", "new")]


def test_writers_at_once(spark, tmp_path):
    at = str(tmp_path)
    store.init_store(spark, at, 2)
    faults = []

    def work(k):
        try:
            store.seed(rows(spark, (f"d{k}", 0, f"text {k}"), ("shared", k, f"by {k}")), at)
        except Exception as e:
            faults.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = held(store.read_store(spark, at))
    assert not faults and [x for x in got if x[0] != "shared"] == [(f"d{k}", f"text {k}") for k in range(4)]
    assert len([x for x in got if x[0] == "shared"]) == 1  # the last one to publish replaced the others' whole
    table = Snapshots(spark, at)
    with pytest.raises(Conflict):
        table.publish(table.read()[0], {})


def test_compaction_meets_a_writer_and_another_compaction(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    store.init_store(spark, at, 2)
    for k in range(3):
        store.seed(rows(spark, ("a", 0, str(k)), (f"n{k}", 0, "n"), (None, 0, f"null {k}")), at)
    read = store._read

    def meanwhile(other):
        def reading(*x):
            monkeypatch.setattr(store, "_read", read)
            other()
            return read(*x)

        monkeypatch.setattr(store, "_read", reading)

    meanwhile(lambda: store.seed(rows(spark, ("n0", 0, "late")), at))
    assert store.compact(spark, at)
    want = [("a", "2"), ("n0", "late"), ("n1", "n"), ("n2", "n"), (None, "null 2")]
    assert held(store.read_store(spark, at)) == sorted(want, key=str)
    meanwhile(lambda: store.compact(spark, at))
    assert not store.compact(spark, at)
    monkeypatch.setattr(store, "COMPACT_AT", 2)
    for k in range(3):
        store.seed(rows(spark, ("z", 0, str(k))), at)
    assert held(store.read_store(spark, at)) == sorted([*want, ("z", "2")], key=str) and len(Snapshots(spark, at).read()[1]["deltas"]) <= 2


def test_fingerprints_follow_the_files(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    one = fingerprint(spark, at)
    assert one == fingerprint(spark, at)
    spark.range(3).write.mode("overwrite").parquet(at)
    assert one != fingerprint(spark, at)


def test_the_round_trip_appends_every_chunk(spark, tmp_path, monkeypatch):
    docs = [(1, "one\ntwo\n\nthree", "en", "web"), (2, "x", "de", None), (3, None, "en", "web"), (4, "\n", None, "web"), (5, "\n \nlate\nlater", "fr", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(queries, "new_folder", lambda spark, name: f"{tmp_path}/{name}")
    got = sorted((r.source_doc, r.chunk_index) for r in queries.chunk_store_roundtrip(spark, f"{tmp_path}/in").collect())
    assert got == [("d-1", 0), ("d-1", 1), ("d-1", 3), ("d-2", 0), ("d-5", 2), ("d-5", 3)]
    # the first of the store's writes was the plain insert, the others took its place
    at = f"{tmp_path}/roundtrip/store"
    assert [len(Snapshots(spark, at).read(v)[1]["deltas"]) for v in Snapshots(spark, at).versions()] == [0, 1, 2, 3]
    assert all(sorted((r.source_doc, r.chunk_index) for r in store.read_store(spark, at, v).collect()) == got for v in (2, 3, 4))


def test_what_the_last_write_brought_is_not_joined(spark, tmp_path):
    at = str(tmp_path)
    store.init_store(spark, at, 2)
    store.append(rows(spark, ("f", 0, "one"), ("g", 0, "x")), at)
    store.seed(rows(spark, ("f", 0, "two"), ("f", 1, "three")), at)
    store.append(rows(spark, ("f", 2, "four")), at)
    got = store.read_store(spark, at)
    assert held(got) == [("f", "four"), ("f", "three"), ("f", "two"), ("g", "x")]
    # a union of what is older, which meets the names of what was replaced, and the two that can't be gone
    older, newer = (lambda u: (u.apply(0), u.apply(1)))(got._jdf.queryExecution().optimizedPlan().children())
    assert "Join" in older.toString() and "Join" not in newer.toString()
