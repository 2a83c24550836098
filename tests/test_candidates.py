"""Candidates meet their texts by few rows, and what follows starts from written rows."""

from pyspark.sql import functions as F

from corpusloom.jobs import pipeline


def test_candidates_are_written_before_they_meet_texts(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 200).alias("content")).write.parquet(str(tmp_path / "docs"))
    texts = spark.read.parquet(str(tmp_path / "docs"))
    queries = spark.createDataFrame([(1, "word 7"), (2, "word 9")], "query_id long, query string")
    found = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 9), (2, 2, 7)], "query_id long, rank int, doc_id long").repartition(3, "query_id")
    rows = pipeline.with_chunks(found, texts, queries, ["doc_id"])
    best = pipeline.reranked(rows, 1)
    assert not any("docs" in f for f in best.inputFiles())  # used twice, it reads the texts once
    assert sorted((r.query_id, r.rank, r.doc_id) for r in best.collect()) == [(1, 1, 7), (2, 1, 9)]
