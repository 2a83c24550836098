"""What the pipeline's first stage decides."""

import random

import corpus_pipeline


def test_documents_in_no_learned_language_go(spark):
    r = random.Random(8)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 7)))
    make = lambda letters, n=60: " ".join(word(letters) for _ in range(n))
    rows = [(i, make("abcdetinos"), "en", f"s{i % 3}", 1, "x") for i in range(200)] + [(1000 + i, make("aäbcßrewü"), "de", "s", 1, "x") for i in range(200)]
    rows += [(2000 + i, make("абвгдежз"), None, "s", 1, "x") for i in range(20)] + [(3000 + i, make("abcdetinos"), None, "s", 1, "x") for i in range(20)]
    rows += [(4000, None, None, None, None, None), (4001, "12 34", "en", "s", 1, "x"), (4002, "A.", "en", "s", 1, "x"), (4003, make("aäbcßrewü", 3), None, "s", 1, "x"), (4004, make("abcdetinos").upper(), None, "s", 1, "x")]
    docs = corpus_pipeline.materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string"), "test")
    got = {x.doc_id: x for x in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert set(got) == {i for i, *_ in rows if i < 2000 or 3000 <= i < 3020 or i in (4002, 4003, 4004)}
    assert all(got[i].lang == "en" and got[i].text == t and got[i].lang_pred == "x" for i, t, *_ in rows if 3000 <= i < 3020) and got[4003].lang == "de" and got[4004].lang == "en" and got[4004].text.isupper()
    assert corpus_pipeline.identify_language(spark, docs.limit(0), "").columns == docs.columns
