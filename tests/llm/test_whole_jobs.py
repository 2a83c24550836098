"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, language_id, mixing, simhash, site_style, topk, url_rules, warc


def _shingles(text, n=5):
    w = text.lower().split()
    return {" ".join(w[k:k + n]) for k in range(max(len(w) - n, 0) + 1)}


def _near_rows():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(5):  # families whose members overlap by about 0.6 to 1 with their base
        base = [word() for _ in range(300)]
        for k in range(10):
            w = list(base)
            for at in r.sample(range(300), k):
                w[at] = word()
            rows.append((len(rows), " ".join(w)))
    return rows


def _components(rows, similarity=0.8):
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_copies_have_the_similarity(spark):
    import corpus_pipeline

    rows = _near_rows()
    want = _components(rows)
    assert len(set(want.values())) > 5  # some members of a family are too far from all others
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = corpus_pipeline.materialise(docs, "test")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == sorted(i for i in want if want[i] == i)
    # components cut into tiles
    got = simhash.near_duplicates(docs, shingle=5, bits=512, radius=200, minima=6, similarity=0.8, lanes=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_similar_links_settle_every_pair():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 12, r.integers(1, 12)).astype(np.uint64)) for _ in range(80)]
    share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = simhash.similar_links(sets, np.arange(80), np.ones(80, bool), 0.8)
    assert all(share(sets[i], sets[j]) >= 0.8 for i, j in got)
    label = np.arange(80)
    for i, j in got:
        label[label == label[j]] = label[i]
    assert all(label[i] == label[j] for i in range(80) for j in range(80) if share(sets[i], sets[j]) >= 0.8)


def test_copies_of_a_page_count_once(spark):
    page = "<body><ul class='links'><li>Home</ul><p>{}</p>"
    table = "<body><table><tr>" + "<td>yes</td>" * 12 + "<td>no</td>" * 8 + "</tr></table>"
    pages = [("http://a/", page.format("same"))] * 5 + [("http://b/", page.format("copy"))] * 80 + [("http://b/", page.format(f"own {i}")) for i in range(20)] + [("http://c/", table)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_style.main_text(df).collect()}
    assert all(got[i] == "Home\n\nsame" for i in range(5))  # one page: nothing to tell a menu by
    assert all(got[i] == "copy" for i in range(5, 85)) and all(got[85 + i] == f"own {i}" for i in range(20))
    assert got[105].split() == ["yes"] * 12 + ["no"] * 8


def test_names_of_layouts_lose_no_article():
    def article(page):
        marked, found, _ = site_style.blocks(page)
        return [text for _, kind, text in found if kind == (site_style.ARTICLE if marked else site_style.BODY)]

    for name in ("content-sidebar", "header-fixed", "layout-sidebar", "nav-open", "social-science", "notice-period", "sidebar", "widget"):
        assert article(f"<body class='{name}'><article><p>Text</article>") == ["Text"]
        assert article(f"<body><div id='{name}'><div><article><p>Text</article></div></div>") == ["Text"]
        assert article(f"<main><div class='{name}'><p>Intro<article><p>Text</article></div></main>") == ["Intro", "Text"]
        assert article(f"<main class='{name}'><p>Text</main>") == ["Text"]
    assert article("<body><article><p>One<section class='social-science'><p>Two</section></article>") == ["One", "Two"]
    assert article("<body class='notice-period'><p>Text") == ["Text"]
    # still noise: whole names, comments as articles inside the article, teasers beside it, tags
    assert article("<article><p>One<div class='x ad'>ad</div><div class='comments'><article>c</article></div></article><div class='related'><article>t</article></div>") == ["One"]
    assert article("<article><p>One<aside><article>a</article></aside><div role='navigation'>m</div></article>") == ["One"]


def test_rules_are_mined_from_all_rows(spark):
    # one shape holds a third of 600,000 rows; the confidences are those of the whole table
    n = spark.range(600_000)
    tokens = F.when(F.col("id") % 3 == 0, F.array(F.lit("path:hot"))).otherwise(F.array(F.concat(F.lit("path:"), F.col("id") % 7), F.lit("x" * 90)))
    label = F.when(F.col("id") % 50 == 0, "allow").otherwise("block")
    got = {tuple(r.antecedent): (round(r.support * 600_000), r.confidence) for r in url_rules.mine(n.select(tokens.alias("tokens"), label.alias("label"))).collect() if r.label == "block"}
    rows = [i for i in range(600_000) if i % 3 == 0]
    assert got[("path:hot",)] == (sum(i % 50 > 0 for i in rows), sum(i % 50 > 0 for i in rows) / len(rows))
    long = spark.createDataFrame([("http://a.net/" + "y" * 100,)], "url string").select(url_rules.tokens(F.col("url"), url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("t")).first().t
    assert "path:" + "y" * 100 in long


def test_texts_without_any_label_pass(spark):
    import corpus_pipeline

    rows = [(1, "some words", None), (2, "12", None), (3, None, None), (4, "", None)]
    docs = corpus_pipeline.materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "test")
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()] == [1]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("copies", "loom_row", "row", "doc", "id", "loom_bucket", "size", "label", "component_id", "kept", "lang_pred", "file", "place", "times", "_metadata")


def _documents(n, clashes=()):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(("one", "two", "three", "four", "five")) for _ in range(r.randint(1, 60))), "en", f"s{i % 3}", 1) for i in range(n)]
    rows += [(i, t, *rest) for i, t, *rest in rows[: n // 2]]  # rows that repeat others wholly
    return [(*row, *range(len(clashes))) for row in rows], ", ".join([COLUMNS, *(f"{c} long" for c in clashes)])


def test_rows_keep_their_numbers_when_files_are_split_otherwise(spark, tmp_path):
    """Executors come and go between two scans, and with them how Spark splits the files."""
    import corpus_pipeline
    from corpusloom.llm._common import numbered

    rows, kinds = _documents(4000)
    path = str(tmp_path / "documents")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    spark.createDataFrame(rows, kinds).repartition(3).sortWithinPartitions("doc_id").write.option("parquet.block.size", 20_000).parquet(path)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        seen = []
        for parts, size in (("1", "128m"), ("9", "128m"), ("30", "8k")):
            spark.conf.set("spark.sql.files.minPartitionNum", parts)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = numbered(spark.read.parquet(path))
            seen.append((found.rdd.getNumPartitions(), {(x.row.file, x.row.place): (x.doc.doc_id, x.doc.text) for x in found.collect()}))
        assert len({n for n, _ in seen}) > 1 and all(len(x) == len(rows) and x == seen[0][1] for _, x in seen)
        # the decisions of a stage are taken under one split and applied under another
        docs = spark.read.parquet(path)
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        kept = corpus_pipeline.drop_exact_copies(spark, docs, "")
        spark.conf.set("spark.sql.files.minPartitionNum", "30")
        got = sorted((x.doc_id, x.text) for x in kept.collect())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    last = {}
    for i, t, *_ in rows:
        last[t] = max(i, last.get(t, i))
    assert got == sorted((i, t) for t, i in last.items())


def test_stages_with_clashing_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rows, kinds = _documents(40, CLASHES)
    for no, docs in enumerate((spark.createDataFrame(rows, kinds), spark.createDataFrame([], COLUMNS))):
        columns = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{no}-{name}")
            docs.write.mode("overwrite").parquet(path + "-in")
            out = stage(spark, spark.read.parquet(path + "-in"), "")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        assert (docs.count() == 0) == bool(no)


def test_scratch_tables_go(spark):
    import os

    from corpusloom.llm._common import materialise, scratch, shared_root

    folder = shared_root(spark).removeprefix("file://") + "/loom"
    with scratch(spark):
        inside = materialise(spark.range(3), "inside")
        assert inside.count() == 3
        names = set(os.listdir(folder))
        assert any(n.startswith("inside") for n in names)
    assert not any(n.startswith("inside") for n in os.listdir(folder))


def test_equal_rows_and_collisions_in_exact_dedup(spark, monkeypatch):
    rows = [(None, "Same text")] * 50 + [(None, "other")] * 3 + [(1, "other"), (2, "OTHER"), (3, "ba"), (4, "ab"), (5, "AB")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((None, None, 50)) for _ in range(50)) + [(None, 2, 5)] * 3 + [(1, 2, 5), (2, 2, 5), (3, 3, 1), (4, 5, 2), (5, 5, 2)]
    key = lambda r: tuple(str(x) for x in r)
    got = exact_dedup.dedup_groups(df, per_copy=4).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=key) == sorted(want, key=key) and sum(r.kept for r in got) == 4
    # every text of one length has the same fingerprint: the comparison of chunks tells them apart
    plain = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda docs, huge: plain(docs, huge).withColumns({"fp1": F.lit(1).cast("long"), "fp2": F.lit(1).cast("long")}))
    got = exact_dedup.dedup_groups(df, per_copy=4).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=key) == sorted(want, key=key) and sum(r.kept for r in got) == 4


def test_words_come_near_their_targets_and_equal_rows_are_spread(spark):
    r = random.Random(4)
    rows = [(i, f"s{i % 4}", r.choice((1, 5, 40, 300, 2000))) for i in range(240)] + [(None, "s1", 7)] * 20_000
    df = spark.createDataFrame(rows, "doc_id long, source string, n int").select("doc_id", "source", F.repeat(F.lit("w "), F.col("n")).alias("text"))
    got = mixing.mix(df).groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("most"), F.max("copies").alias("copies"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(x.n for x in got) == len(rows) and max(x.copies for x in got) <= 3
    assert all(abs(x.taken - x.target) <= max(0.03 * x.target, x.most / 2) for x in got)
    again = mixing.mix(df.repartition(7)).groupBy("doc_id", "copies").count()
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.mix(df).groupBy("doc_id", "copies").count().collect()))


def test_style_tree_against_brute_force(spark):
    """Importances of a host of 20 pages, and boilerplate that no name gives away, with and without an article."""
    import math
    from collections import Counter, defaultdict

    r = random.Random(3)
    def page(i, tag):  # noqa: E306
        body = "".join(f"<p>{r.random()} {i}" for _ in range(r.randint(1, 3)))
        return f"<body><div class='x1'><h2>Our promise<p>We care {i % 2}</div><{tag}><h1>T{i}</h1>{body}<div class='x2'>Read it all</div></{tag}></body>"
    pages = [("http://a/", page(i, "div")) for i in range(20)] + [("http://b/", page(i, "article")) for i in range(20)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    parsed = df.select("page_id", F.substring("url", 8, 1).alias("host"), "html").mapInArrow(site_style._parse, f"page_id long, host string, {site_style._BLOCKS}")
    got = {(x.host, x.path): x for x in site_style.style_tree(parsed).collect()}
    ent = lambda xs: (lambda c, n: -sum(v / n * math.log(v / n) for v in c.values()) / math.log(n) if n > 1 else 1.0)(Counter(xs), len(xs))
    shown, content = defaultdict(list), defaultdict(list)
    for url, html in pages:
        _, rows, nodes = site_style.blocks(html)
        for p, x in nodes.items():
            shown[url[7], p].append(" ".join(x))
        for p, t in {(p, t) for p, _, t in rows}:
            content[url[7], p].append(t)
    for (host, path), x in got.items():
        leaves = [v for (h, p), v in content.items() if h == host and (p + "/").startswith(path + "/")]
        below = sum(len(v) * ent(v) for v in leaves) / sum(map(len, leaves))
        assert x.pages == len(shown[host, path]) and math.isclose(x.importance, 0.9 * below + 0.1 * ent(shown[host, path]), abs_tol=1e-9)
    assert any(p.endswith("x1") for _, p in got) and len(got) > 8
    texts = [x.text for x in site_style.main_text(df).orderBy("page_id").collect()]
    for i, text in enumerate(texts):
        assert text.startswith(f"T{i % 20}\n\n0.") and "promise" not in text and "We care" not in text and "Read it all" not in text


def test_articles_keep_their_words(spark):
    def article(page):
        marked, found, _ = site_style.blocks(page)
        return [text for _, kind, text in found if kind == (site_style.ARTICLE if marked else site_style.BODY)]

    assert article("<body><header>Site</header><article><header><h1>Title</h1></header><p>Let <math><mi>x</mi>=<mn>2</mn></math> be <label>small</label> <object>shown</object></article>") == ["Title", "Let x=2 be small shown"]
    assert article("<article><p>One<section class='social-history'><p>Two</section><section class='share-prices'><p>Three</section></article>") == ["One", "Two", "Three"]
    # one article under many menus is one page: its words aren't what the site repeats
    same = [(i, "http://h/", f"<body><nav>{i}</nav><article><p>The same article</article>") for i in range(50)] + [(100 + i, "http://h/", f"<body><nav>n</nav><article><p>Own {i}</article>") for i in range(10)]
    got = {x.page_id: x.text for x in site_style.main_text(spark.createDataFrame(same, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "The same article" for i in range(50)) and all(got[100 + i] == f"Own {i}" for i in range(10))
    assert site_style.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mined_rules_against_brute_force(spark):
    from itertools import combinations

    r = random.Random(8)
    rows = []
    for _ in range(150):
        tokens = sorted({"host:" + r.choice(("net", "com", "x", "y")), "path:" + r.choice("abc"), "key:" + r.choice("pq")})
        rows.append((tokens, "block" if "path:a" in tokens or "host:net" in tokens else r.choice(("allow", "block"))))
    rows += [(["path:rare"], "block")] * 4
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    got = {(tuple(x.antecedent), x.label): (round(x.confidence, 9), round(x.support * len(rows))) for x in url_rules.mine(df, given=["host:net", "host:com"]).collect()}
    want = {}
    for n in (1, 2, 3):
        for some in {c for t, _ in rows for c in combinations(t, n)} - {("host:net",), ("host:com",)}:
            labels = [lab for t, lab in rows if set(some) <= set(t)]
            for lab in ("allow", "block"):
                hits = labels.count(lab)
                if hits >= 5 and hits / len(labels) >= 0.9:
                    want[some, lab] = (round(hits / len(labels), 9), hits)
    assert got == want and (("path:rare",), "block") not in got
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_frequent_keys_of_fingerprints_lose_no_link(spark):
    r = random.Random(6)
    prints = {r.getrandbits(26) << 20 | 12345 for _ in range(120)} | {r.getrandbits(64) for _ in range(30)}
    prints |= {p ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for p in list(prints)[:80]}
    rows = [(i, bytearray(p.to_bytes(8, "big"))) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "node long, fp binary")
    keyed = df.withColumn("keys", simhash.pigeonhole_keys(F.col("fp"), 2, 5))
    edges = simhash.links(keyed, 2, 8, 8, lambda fp, k: simhash.finer_keys(fp, k, 2, 5))
    root = {x.node: x.root for x in simhash.components(edges).collect()}
    value = {i: int.from_bytes(b, "big") for i, b in rows}
    near = [(i, j) for i in value for j in value if i < j and (value[i] ^ value[j]).bit_count() <= 2]
    assert len(near) > 60 and all(root[i] == root[j] for i, j in near) and all((value[x.a] ^ value[x.b]).bit_count() <= 2 for x in edges.collect())
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


class _Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, data):
        import io

        self.file, self.n = io.BytesIO(data), 0

    def read(self, n):
        out = self.file.read(n)
        self.n += len(out)
        return out

    def seek(self, *at):
        return self.file.seek(*at)


def test_unwanted_payloads_are_passed_over(monkeypatch):
    import gzip

    r = random.Random(1)
    rows = [{"payload": r.randbytes(400_000), "payload_bytes": 400_000, "record_type": "response", "record_id": f"urn:{i}", "date": "d", "target_uri": "u", "payload_digest": "x"} for i in range(20)]
    plain = b"".join(map(warc.encode_record, rows))
    packed = b"".join(warc._gzip(warc.encode_record(x)) for x in rows)
    assert gzip.decompress(packed) == plain
    strange = b"".join(gzip.compress(warc.encode_record(x)) for x in rows)  # members that don't tell their length
    made = []
    inner = warc._Bytes.take
    monkeypatch.setattr(warc._Bytes, "take", lambda self, n: made.append(n) or inner(self, n))
    for data, gz, jumps in ((plain, False, True), (packed, True, True), (strange, True, False)):
        for wanted, payload in ((lambda x: x["record_id"] == "urn:7", True), (lambda x: True, False), (lambda x: True, True)):
            made.clear()
            f = _Counted(data)
            got = list(warc.records(f, gz, wanted, payload))
            assert [x["payload"] for x in got] == [rows[int(x["record_id"][4:])]["payload"] if payload else None for x in got] and len(got) in (1, 20)
            assert all(x["payload_bytes"] == 400_000 for x in got) and len(made) == (len(got) if payload else 0)
            if jumps and len(made) < 20:
                assert f.n < len(data) / 2
    for data, gz in ((plain[:-500_000], False), (packed[:-500_000], True)):
        try:
            list(warc.records(_Counted(data), gz, lambda x: True, False))
            raise AssertionError("a cut file reads as whole")
        except EOFError:
            pass


def test_archives_grow_and_give_headers_alone(spark):
    path = warc.scratch_path(spark, "grow")
    frame = lambda *ids: spark.createDataFrame([(i, "u", "text " * 50 + str(i)) for i in ids], "page_id long, url string, html string")
    warc.archive(frame(1, 2), path)
    warc.archive(frame(3), path)
    read = spark.read.format("warc")
    assert sorted(x.record_id for x in read.load(path).collect()) == ["urn:row:1", "urn:row:2", "urn:row:3"]
    heads = read.option("payload", "false").load(path)
    assert "payload" not in heads.columns and heads.where("record_id = 'urn:row:3'").first().payload_bytes == 251
    warc.to_records(frame(9), "page_id", "url", "html").write.format("warc").mode("overwrite").save(path)
    assert [x.record_id for x in spark.read.format("warc").load(path).collect()] == ["urn:row:9"]


def test_bounds_hold_and_prune_clusters():
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 16)) * 1000
    m = np.concatenate([c + r.normal(size=(64, 16)) * 60 for c in centres]).astype(np.int64)
    q = m[::97]
    blocks = m.reshape(-1, 64, 16)
    middle = blocks.mean(1)
    radius = np.sqrt(((blocks - middle[:, None]) ** 2).sum(2)).max(1)
    got = topk.bounds(q, blocks.max(1), blocks.min(1), middle, radius)
    exact = np.einsum("qd,bvd->qbv", q, blocks)
    assert (got >= exact.max(2)).all()
    kth = np.sort((q @ m.T), axis=1)[:, -10]
    assert (got < kth[:, None]).mean() > 0.8


def test_prices_sum_to_one(spark):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("abracadabra " * 9, "x"), ("kayak kayak é", "y"), ("zz", "x")])], "doc_id long, text string, lang string")
    for nodes in (1, 7, 2_048):
        m = language_id.fit(df, "doc_id", "text", "lang", nodes_per_language=nodes)
        known = len(np.unique(m.symbol)) - 1
        assert all(len(p) <= nodes for p in m.prices)
        for p in m.prices:
            share = np.exp2(-p.astype(np.float64))
            # symbol 0 stands for each of the bytes that no text has
            assert np.allclose(share[:, 1:].sum(-1) + share[:, 0] * (256 - known), 1, atol=1e-4)


def _code_length(texts, text, nodes):
    """Bits by the definition: counts in dictionaries, one byte at a time."""
    seen = {}
    for t in texts:
        data = b"\0\0\0" + t.encode()
        for i in range(3, len(data)):
            for k in range(4):
                own = seen.setdefault(data[i - k:i], {})
                own[data[i]] = own.get(data[i], 0) + 1
    tree = set(sorted(seen, key=lambda c: (-sum(seen[c].values()), len(c), c))[:nodes])

    def share(context, byte):
        if context is None:
            return 1 / 256
        shorter = share(context[1:] if context else None, byte)
        if context not in tree:
            return shorter
        total, kinds = sum(seen[context].values()), len(seen[context])
        return (seen[context].get(byte, 0) + kinds * shorter) / (total + kinds)

    data = b"\0\0\0" + text.encode()
    return sum(-np.log2(share(data[i - 3:i], data[i])) for i in range(3, len(data)))


def test_code_lengths_against_the_definition(spark):
    r = random.Random(5)
    texts = {lang: ["".join(r.choice(letters) for _ in range(120)) for _ in range(6)] for lang, letters in (("x", "aab é"), ("y", "abcdß "), ("z", "dcba"))}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = ["abé", "", "dcbß ab" * 9, "aaaa"]
    for nodes in (5, 40, 2_048):
        got = language_id.code_lengths(language_id.fit(df, "doc_id", "text", "lang", nodes_per_language=nodes), asked)
        want = [[_code_length(texts[lang], t, nodes) for lang in "xyz"] for t in asked]
        assert np.allclose(got, want, rtol=1e-5)


def test_language_columns_may_clash(spark):
    rows = [(i, "theron ing" if i % 2 else "schung ei", "en" if i % 2 else "de", "de", 2.0, True, "q") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, letters boolean, id string")
    assert all(x.lang_pred == ("en" if x.doc_id % 2 else "de") for x in language_id.identify(df).collect())
