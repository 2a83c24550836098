"""From raw documents to packed training sequences: five stages, each a Spark job of its own.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), and its result is
written as Parquet and reread as the next one's docs. All but the last return the columns of
``documents``. Rows are told apart by the file and place they are read from, which no split of the
files and no change of the cluster alters, so null or repeated ids and wholly equal rows are
handled one by one; an empty table gives empty results. Columns besides those of ``documents``
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, language_id, mixing, packing, simhash
from corpusloom.llm._common import materialise, numbered, possibly, remove, scratch, scratch_path, table
from corpusloom.llm.queries import PACK_TOKENIZER

#: Near copies in the pipeline: five-word shingles that overlap by 0.8 or more. Such texts differ in
#: about 78 of 512 fingerprint bits, with a spread of 8; the radius only chooses what is compared exactly.
NEAR_SHINGLE, NEAR_BITS, NEAR_RADIUS, NEAR_MINIMA, NEAR_SIMILARITY = 5, 512, 112, 6, 0.8

#: What a byte costs without any model.
PLAIN_BITS = 8.0


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of ``rows`` (row, doc) but for those of ``dropped`` (row)."""
    gone = materialise(dropped, "dropped")
    maybe, stays = possibly(rows, gone, ["row"])
    return stays.unionByName(maybe.join(gone.hint("merge"), "row", "left_anti")).select("doc.*")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language, and write the predicted one where none is given.

    A document is rejected if it is null or has no letter, or if no language's model codes it, or
    else its lower-cased form, in fewer than ``PLAIN_BITS`` bits a byte: then plain bytes would be
    the shorter code, as for text in scripts that no labelled document has. Where no document has a
    label nothing is learned, and only the first applies.
    """
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    if not model.languages:
        return docs.where(language_id.has_letter(F.col("text")))
    found = language_id.predict(docs.select(F.struct("*").alias("doc"), F.col("text").alias("text")), model, fold_above=PLAIN_BITS)
    good = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("bits_per_byte") < PLAIN_BITS))
    return good.select(*(F.coalesce("doc.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the row with the largest doc_id stays."""
    rows = numbered(docs)
    found = exact_dedup.dedup_groups(rows.select(F.struct("doc.doc_id", "row").alias("id"), "doc.text"), "id")
    return _without(rows, found.where(~F.col("kept")).select("id.row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose shingles overlap by 0.8 or more the row with the smallest doc_id stays."""
    rows = numbered(docs)
    place = F.struct(F.col("doc.doc_id").isNull().alias("unknown"), "doc.doc_id", "row")
    found = simhash.near_duplicates(rows.select(place.alias("id"), "doc.text"), "id", "text", NEAR_SHINGLE, NEAR_BITS, NEAR_RADIUS, minima=NEAR_MINIMA, similarity=NEAR_SIMILARITY)
    return _without(rows, found.where(F.col("id") != F.col("component_id")).select("id.row"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = numbered(docs)
    taken = mixing.mix(rows.select("row", "doc.source", "doc.text"), "row").where("copies > 0")
    times = taken.select("row", F.sequence(F.lit(1), "copies").alias("times"))
    return rows.join(times.hint("merge"), "row").select("doc", F.explode("times")).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, PACK_TOKENIZER())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language models, random rounding and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's scratch tables go once its result is written, and that once the next one's is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name, path)
        if last:
            remove(spark, [last])
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
