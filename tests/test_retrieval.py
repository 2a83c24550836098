"""Retrieval operators against literal models and hand-made cases."""

import math
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.functions import text as T
from corpusloom.operators import answering, chunking, context, dense, filings, fusion, lexical


def test_settings_validate():
    assert Settings(tier_providers=(("simple", "vllm"),)).chain("simple")[0] == "vllm"
    assert Settings(tier_providers=(("simple", "none"),)).chain("simple") == list(Settings().fallback_chain)
    for bad in ({"fallback_chain": ()}, {"fallback_chain": ("a", "a")}, {"chunk_overlap": 1000}, {"rrf_k": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_text_functions(spark):
    rows = [("Revenue was $383.3 in 2023, up 5%", "what was net income vs. costs", "<think>a\nb</thinking> yes <think>open"), ("", " VS next", "  x ")]
    df = spark.createDataFrame(rows, "a string, q string, t string")
    got = df.select(T.tokenize(F.col("a")), T.complexity(F.col("q")), T.strip_think(F.col("t"))).collect()
    assert got[0][0] == ["revenue", "was", "$383.3", "in", "2023", "up", "5%"] and got[0][1] == "complex" and got[0][2] == "yes <think>open"
    assert got[1][1] == "normal" and got[1][2] == "x"
    one = spark.createDataFrame([("One. Two!\n Three?",)], "a string").select(T.sentences(F.col("a"))).first()[0]
    assert one == ["One.", "Two!", "Three?"]


def _bm25(docs, query):
    toks = {i: re.findall(T.TOKEN, t.lower()) for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    terms = {t for x in toks.values() for t in x}
    raw = {t: math.log(n - df + 0.5) - math.log(df + 0.5) for t in terms for df in [sum(t in x for x in toks.values())]}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else floor for t, v in raw.items()}
    score = lambda x: sum(idf.get(t, 0) * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in re.findall(T.TOKEN, query.lower()))
    return {i: round(score(x), 6) for i, x in toks.items() if score(x) > 0}


def test_bm25_matches_the_formula(spark):
    docs = [(1, "apple pie apple"), (2, "apple tart"), (3, ""), (4, "cherry cake with cherry"), (5, "plum")]
    df = spark.createDataFrame(docs, "doc_id long, content string")
    q = spark.createDataFrame([(1, "apple apple cherry unknown"), (2, "nothing here")], "query_id long, query string")
    got = lexical.bm25_search(df, q, ["doc_id"], 10).collect()
    assert {r.doc_id: r.score for r in got if r.query_id == 1} == _bm25(docs, "apple apple cherry unknown")
    assert not [r for r in got if r.query_id == 2]


def test_fusion_and_rerank_reorder(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, None, 2), (1, 7, 3)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, None, 1), (1, 9, 2)], "query_id long, doc_id long, rank int")
    got = {r.doc_id: r.score for r in fusion.fuse(a, b, ["doc_id"]).collect()}
    assert got == {7: round(0.6 / 61 + 0.6 / 63, 9), None: round(0.6 / 62 + 0.4 / 61, 9), 9: round(0.4 / 62, 9)}
    rows = spark.createDataFrame([(1, 1, "q words", "none"), (1, 2, "q words", "q words"), (1, 3, "q words", "words")], "query_id long, rank int, query string, content string")
    assert [r.content for r in fusion.rerank(rows, 2).orderBy("rank").collect()] == ["q words", "words"]
    assert "rerank_score" not in fusion.rerank(rows, 2, None).columns


def test_dense_handles_zero_null_and_length(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0])], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<float>")
    got = dense.dense_search(v, q, ["doc_id"], 5).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got][:2] == [(1, 1.0), (5, 0.707107)] and all(r.score is None for r in got[2:])
    e = dense.embed(spark.createDataFrame([("a b",), (" \n",), ("c",)], "content string"), dense.hashed_embedder(8), batch=1)
    assert e.count() == 2 and dense.dimension_check(e, 4).first() == (2, 2)


def test_fold_budget():
    chunks = [{"rank": 1, "sentences": [("a b c", 1.0, True), ("d e", 0.7, True)]}, {"rank": 2, "sentences": [("f g h i", 0.5, True), ("j", 0.4, True)]}, {"rank": 3, "sentences": [("k", 1.0, True)]}]
    assert context.fold(chunks, 9) == [(1, "a b c d e"), (2, "f g h i")]
    assert context.fold([{"rank": 1, "sentences": [("x" * 50, -1.0, False)]}], 1) == [(1, "x" * 50)]
    assert context.fold([{"rank": 1, "sentences": [("one two three", 1.0, True)]}], 2) == [(1, "one two ")]


def test_context_and_sources(spark):
    rows = spark.createDataFrame([(1, 2, " b ", "T", None, None, "s"), (1, 1, "a", "T", "10-K", "FY2023", "s")], "query_id long, rank int, content string, ticker string, filing_type string, fiscal_period string, section string")
    assert context.context(rows).first().context == "[1] (source: T, 10-K, FY2023, s)\na\n\n[2] (source: T, None, None, s)\nb"
    assert context.sources(rows).first().sources == ["T 10-K FY2023 | s", "T None None | s"]


def test_splitter():
    assert chunking.split_text("short", 10, 2) == ["short"]
    assert chunking.split_text("", 10, 2) == [] and chunking.split_text("  ", 10, 2) == []
    assert chunking.split_text("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert all(len(c) <= 20 for c in chunking.split_text("word " * 50 + "x" * 45, 20, 5))


def test_chunk_index_and_offset(spark):
    s = spark.createDataFrame([("f", 0, "A", "aaaa\nbbbb"), ("f", 1, "B", "cc")], "source_file string, section_no int, section string, text string")
    got = chunking.chunk_sections(s, 6, 1).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.section, r.char_offset, r.content) for r in got] == [(0, "A", 0, "aaaa"), (1, "A", 3, "bbbb"), (2, "B", 0, "cc")]


def test_filing_parser(spark):
    body = "<TYPE>10-K\n<FILENAME>aapl-2023.htm\n<p>For the fiscal year ended June 30, 2023</p>Item 1A. Risk Factors x Item 1B. Unresolved <b>Item&nbsp;</b>Item 1A.&nbsp;Risk Factors<p>Ap<b>ple</b> &amp; co<p>two</p>Item 1B. Unresolved"
    r = filings.parse(spark.createDataFrame([("x.html", body), ("zz-10K.html", "none")], "source_file string, html string")).orderBy("source_file").collect()
    assert (r[0].ticker, r[0].filing_type, r[0].fiscal_period, r[0].warnings) == ("aapl", "10-K", "FY2023", ["Section 'Item 7 MD&A' could not be extracted"])
    assert r[0].sections[0].text == "Item 1A. Risk Factors\n\nAp ple & co\n\ntwo" and r[0].sections[0].word_count == 9
    assert (r[1].ticker, r[1].filing_type, len(r[1].warnings)) == ("zz", "10-K", 2)
    assert r[0].sections[0].section == "Item 1A Risk Factors"
    years = ["Fiscal year ended September 27, 2025", "<dei:DocumentFiscalYearFocus x='1'> 2024 </dei>", "for the fiscal\nyear ended May 1, 2020", "fiscal year ended&nbsp;May 1, 2021"]
    assert [x[0] for x in spark.createDataFrame([(y,) for y in years], "h string").select(filings.fiscal_period(F.col("h"))).collect()] == ["FY2025", "FY2024", None, "FY2021"]
    assert [filings.decode_bytes(b) for b in ("é".encode(), b"\x93", b"\x81")] == ["é", "“", "�"]


def test_fallback(spark):
    def providers():
        def busy(p):
            raise TimeoutError

        return {"openai": busy, "gemini": lambda p: "<think>x</think> ", "vllm": lambda p: "<think>x</think> ok"}

    df = spark.createDataFrame([(1, "normal", "p")], "query_id long, tier string, prompt string")
    r = answering.ask_providers(df, providers).first()
    assert (r.answer, r.provider) == ("ok", "vllm") and [f.reason for f in r.failures] == ["TimeoutError", "no_credentials", "MalformedResponseError"]
    assert answering.ask_providers(df, dict).first().answer is None


_CHUNK = "source_file string, ticker string, filing_type string, fiscal_period string, section string, chunk_index int, char_offset int, content string, embedding array<float>"


def test_store(spark, tmp_path):
    from corpusloom.sources import store

    at = str(tmp_path / "store")
    row = lambda f, k, text: (f, "t", "10-K", None, "s", k, 3 * k, text, [1.0, 0.0])
    frame = lambda *rows: store.store_rows(spark.createDataFrame(list(rows), _CHUNK))
    stored = lambda: sorted((r.source_doc, r.content) for r in store.read_store(spark, at).collect())
    store.init_store(spark, at, 2)
    store.append(frame(row("f", 0, "one"), row("g", 0, "other")), at)
    store.append(frame(row("f", 0, "one")), at)
    assert stored() == [("f", "one"), ("f", "one"), ("g", "other")]
    for _ in range(2):
        store.seed(frame(row("f", 0, "one"), row("f", 1, "two")), at)
        assert stored() == [("f", "one"), ("f", "two"), ("g", "other")]
    # a document that has no chunk any more, and its bucket with it
    store.seed(frame(), at, spark.createDataFrame([("g",)], "source_doc string"))
    assert stored() == [("f", "one"), ("f", "two")]
    store.seed(frame(), at, spark.createDataFrame([("f",), ("none",)], "source_doc string"))
    store.seed(frame(*(row(f"d{i}", 0, str(i)) for i in range(20))), at)
    assert len(stored()) == 20 and store.compact(spark, at) and len(stored()) == 20
    with pytest.raises(Exception, match="2 components"):
        store.seed(store.store_rows(spark.createDataFrame([("f", "t", "k", None, "s", 0, 0, "x", [1.0])], _CHUNK)), at)
    store.init_store(spark, at, 2)
    assert len(stored()) == 20 and store.store_dimension(spark, at) == 2
    store.init_store(spark, at, 5)
    assert store.store_dimension(spark, at) == 5
    assert store.insert_values(frame(row("f", 0, "one"))).first().embedding == "[1.0,0.0]"


def test_chunk_json(spark, tmp_path):
    from corpusloom.sources import store

    df = spark.createDataFrame([("a/f.html", "t", None, "FY1", "s", k, k, f"text {k}", None) for k in (2, 0, 1)] + [("g.x.htm", "t", None, None, "s", 0, 0, "g", None)], _CHUNK)
    store.write_chunk_json(df, str(tmp_path / "lines"))
    assert store.write_json_files(store.chunk_documents(df), str(tmp_path / "files"), "_chunks") == 2
    assert sorted(p.name for p in (tmp_path / "files").iterdir() if p.suffix == ".json") == ["f_chunks.json", "g.x_chunks.json"]
    assert (tmp_path / "files" / "f_chunks.json").read_text().count("\n") > 5
    for folder, apart in (("lines", False), ("files", True)):
        got = store.read_chunk_json(spark, str(tmp_path / folder), apart).collect()
        assert [(r.chunk_index, r.content, r.fiscal_period) for r in got if r.source_file == "a/f.html"] == [(k, f"text {k}", "FY1") for k in range(3)] and len(got) == 4
    (tmp_path / "files" / "bad_chunks.json").write_text("{not json")
    with pytest.raises(Exception):
        store.read_chunk_json(spark, str(tmp_path / "files"), True).collect()


def test_stream_follows_a_folder(spark, tmp_path):
    from corpusloom.config import Settings
    from corpusloom.sources import store
    from corpusloom.streaming.ingest import follow

    (tmp_path / "in").mkdir()
    body = "<TYPE>10-K\n<p>Item 1A. Risk Factors</p>{}<p>Item 1B. Unresolved</p>"
    args = (spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "checkpoint"), dense.build_embedder("hashed", 8), Settings(embedding_dimensions=8))
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.html").write_text(body.format(name * 3))
        follow(*args).awaitTermination()
    assert sorted(r.source_doc for r in store.read_store(spark, str(tmp_path / "store")).collect()) == ["a.html", "b.html"]


def test_models_counts_and_kept_index(spark, tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        dense.build_embedder("none", 4)
    loads = []
    own = dense.build_embedder("mine", 4, {"mine": lambda: loads.append(1) or dense.hashed_embedder(4)})
    assert own(["a"]) == own(["a"]) and loads == [1]
    scored = spark.createDataFrame([(1, 1, "q", "a"), (1, 2, "q", "bbb")], "query_id long, rank int, query string, content string")
    assert [r.content for r in fusion.rerank(scored, 1, fusion.model_scorer(lambda: lambda q, c: [float(len(x)) for x in c])).collect()] == ["bbb"]
    count = context.bpe_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert count("") == 0 and count("hello world") == 2
    after = scored.where("rank = 1")
    assert context.compression_totals(scored, after, count).first()[1:] == (count("a") + count("bbb"), 1, 1)
    docs = [(1, "apple pie apple"), (2, "apple tart"), (3, "")]
    df, q = spark.createDataFrame(docs, "doc_id long, content string"), spark.createDataFrame([(1, "apple")], "query_id long, query string")
    index = lexical.build_index(df, ["doc_id"], str(tmp_path / "index"))
    again = lexical.open_index(spark, str(tmp_path / "index"), ["doc_id"])
    assert {r.doc_id: r.score for r in lexical.search(again, q, 5).collect()} == _bm25(docs, "apple") and index.keys == again.keys
    empty = lexical.build_index(df.limit(0), ["doc_id"], str(tmp_path / "empty"))
    assert lexical.search(empty, q, 5).count() == 0


def test_entry_imports_without_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpusloom.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'ask' in e.queries()"
    from pathlib import Path

    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1]).returncode == 0
