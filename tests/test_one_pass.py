"""Work that is done once: embeddings of repeated sentences, metrics beside a job, markers of a long filing, long sections."""

import random
import re
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, context, dense, filings


def test_each_sentence_is_embedded_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def embedder(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[1.0, 0.0] if "risk" in t else [0.0, 1.0] if "other" in t else [0.0, 0.0] for t in texts]

    rows = [(q, k, f"what risk {q % 2}", "All risk here. Some other words! Nothing. All risk here.") for q in range(6) for k in (1, 2)]
    df = spark.createDataFrame(rows, "query_id long, rank int, query string, content string")
    got = context.sentence_relevance(df, embedder=embedder).collect()
    assert len(got) == 48 and {(r.sentence, r.sim, r.kept) for r in got} == {("All risk here.", 1.0, True), ("Some other words!", 0.0, False), ("Nothing.", 0.0, False)}
    assert sorted(open(log).read().splitlines()) == ["All risk here.", "Nothing.", "Some other words!", "what risk 0", "what risk 1"]
    cut = context.compress(df, 6, embedder=embedder).orderBy("query_id", "rank").collect()
    assert cut[0].content == "All risk here. All risk here." and cut[0].compressed


def test_metrics_come_from_the_job_itself(spark):
    rows = [(1, 1, "a", "a b c. d e"), (1, 2, "a", "a f g h. i"), (2, 1, "x", "x y")]
    df = spark.createDataFrame(rows, "query_id long, rank int, query string, content string")
    tokens, lengths = Observation(), Observation()
    cut = context.compress(df, 4, observed=tokens)
    assert "CollectMetrics" in cut._jdf.queryExecution().executedPlan().toString()
    left = cut.collect()
    totals = context.compression_totals(df, cut).agg(F.sum("tokens_before"), F.sum("tokens_after")).first()
    assert tokens.get == {"tokens_before": totals[0], "tokens_after": totals[1], "chunks": 3, "chunks_after": len(left)}
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "embedding array<float>")
    observed = dense.observe_dimension(v, 2, lengths)
    assert observed._jdf.queryExecution().executedPlan().toString().count("CollectMetrics") == 1 and observed.count() == 3
    assert lengths.get == {"vectors": 3, "other_length": 2}


def test_last_places_of_all_markers_in_one_pass(spark):
    r = random.Random(9)
    patterns = [r"Item\s*1A\s*\.", r"1A", r"item", r"never", r"a+b"]
    texts = ["".join(r.choice(["Item 1A.", "item\n1a .", "x", "aab", "é𝔸", " ", "Item"]) for _ in range(30)) for _ in range(40)] + ["", None, "ITEM"]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(T.last_places(F.col("t"), patterns)).collect()]
    for t, places in zip(texts, got):
        want = None if t is None else [max((k for k in range(len(t)) if re.match(p, t[k:], re.I | re.S)), default=None) for p in patterns]
        assert places == want, t
    plan = spark.createDataFrame([("x",)], "html string").select(filings.section_slices(F.col("html"), [("a", "b"), ("c", "d")]))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"ArrowEvalPython \[<lambda>\(html#\d+\)#\d+\]", plan) and plan.count("ArrowEvalPython") == 1  # once for all markers


def test_a_long_filing(spark):
    page = "Item 1A. Risk Factors " + "<p>Item 7 and Item 1A words </p>" * 300_000 + " &nbsp;" * 20_000 + "Item 1A." + "&nbsp; " * 20_000 + "Risk Factors text Item 1B. Unresolved"
    df = spark.createDataFrame([("f.html", page)], "source_file string, html string").coalesce(1)
    start = time.time()
    s = df.select(filings.section_slice(F.col("html"), *filings.SECTIONS[0][1:]).alias("s")).first().s
    assert time.time() - start < 60 and s.char_offset == page.rindex("Item 1A.") and s.raw.endswith("text ")


def test_long_sections_split_in_one_pass():
    def plain(text, size, overlap, separators=chunking.SEPARATORS):
        sep = next(s for s in separators if s in text or not s)
        finer = separators[separators.index(sep) + 1:]
        pieces = [p for p in ([x if i == 0 else sep + x for i, x in enumerate(text.split(sep))] if sep else list(text)) if p]
        out, held = [], []
        flush = lambda: out.append("".join(held).strip())
        for p in pieces:
            if len(p) >= size:
                flush()
                held = []
                out += plain(p, size, overlap, finer) if finer else [p]
                continue
            if held and sum(map(len, held)) + len(p) > size:
                flush()
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                    held = held[1:]
            held.append(p)
        flush()
        return [x for x in out if x]

    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choice(["a", "bb", "\n", "\n\n", ". ", " ", "ccc", "é"]) for _ in range(r.randint(0, 100)))
        size = r.randint(2, 30)
        overlap = r.randint(0, size - 1)
        assert chunking.split_text(text, size, overlap) == plain(text, size, overlap)
    start = time.process_time()
    assert all(len(c) <= 1000 for c in chunking.split_text("x" * 2_000_000 + " y" * 500_000, 1000, 150))
    assert time.process_time() - start < 30


def test_texts_come_to_python_by_few(spark):
    from pyspark.util import PythonEvalType

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("source_file"), F.lit(0).alias("section_no"), F.repeat(F.lit("<h1>é</h1> text. "), 80).alias("text"))
    cut = chunking.chunk_sections(docs, 300, 50)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (cut, docs.select(filings.clean_text("text")))]
    assert all("BatchEvalPython" in p and "Arrow" not in p and "MapInPandas" not in p for p in plans)
    plan = docs.select(filings.section_slice(F.col("text"), "<h1", "</h1>"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"pythonUDF0#\d+\], {PythonEvalType.SQL_SCALAR_ARROW_UDF}\b", plan)  # no pandas strings of a whole batch
    one = chunking.split_text(docs.first()["text"], 300, 50)
    assert [r.content for r in cut.where("source_file = 7").orderBy("chunk_index").collect()] == one and cut.count() == 3000 * len(one)


def test_chunk_json_is_made_once_and_words_are_numbered_once(spark):
    from corpusloom.sources import store

    chunks = spark.createDataFrame([("a", 1, 9, "two", "T", "K", None, "s"), ("a", 0, 0, "one", "T", "K", "FY1", "s")], "source_file string, chunk_index int, char_offset int, content string, ticker string, filing_type string, fiscal_period string, section string")
    docs = store.chunk_documents(chunks)
    assert "json" not in docs._jdf.queryExecution().optimizedPlan().toString()
    first, second = docs.first().chunks
    assert (first.content, second.content) == ("one", "two") and first.metadata["fiscal_period"] == "FY1"
    assert second.metadata == {"source_file": "a", "ticker": "T", "filing_type": "K", "fiscal_period": None, "section": "s", "chunk_index": "1", "char_offset": "9"}
    dense._number.cache_clear()
    dense.hashed_embedder(16)(["same words", "words same", "same"])
    assert dense._number.cache_info().misses == 2
