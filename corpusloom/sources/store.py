"""Filings in, parsed documents, chunks out and back: files, JSON and the chunk store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import vector_literal
from ..operators.filings import decode_html
from .snapshots import Snapshots, number_of

CHUNK_JSON = "source_file string, chunks array<struct<content:string,metadata:map<string,string>>>"
_META = ("ticker", "filing_type", "fiscal_period", "section")
#: Bytes of a compacted file, and writes after which a store is compacted.
FILE_BYTES, COMPACT_AT = 128 << 20, 64


class Superseded(Exception):
    """What a compaction has merged isn't what is stored any more."""


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, html) of the ``*.html`` files of a folder, not of those below it, wherever Spark can read; see ``filings_source`` for more."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "false").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("source_file"), decode_html(F.col("content")).alias("html"))


# --- JSON -------------------------------------------------------------------------------------

def chunk_documents(chunks: DataFrame) -> DataFrame:
    """(source_file, chunks): each document's chunks in order, with their metadata as strings."""
    names = ("source_file", *_META, "chunk_index", "char_offset")
    # arrays are sorted, maps can't be
    items = F.array_sort(F.collect_list(F.struct("chunk_index", "char_offset", "content", F.array(*(F.col(c).cast("string") for c in names)).alias("meta"))))
    docs = chunks.groupBy("source_file").agg(items.alias("items"))
    item = lambda x: F.struct(x["content"].alias("content"), F.map_from_arrays(F.array(*(F.lit(c) for c in names)), x["meta"]).alias("metadata"))
    return docs.select("source_file", F.transform("items", item).alias("chunks"))


def write_chunk_json(chunks: DataFrame, folder: str) -> None:
    """A line of JSON per document, in as many files as there are partitions."""
    chunk_documents(chunks).write.mode("overwrite").json(folder)


def write_json_files(docs: DataFrame, folder: str, suffix: str = "") -> int:
    """One indented file ``<stem><suffix>.json`` for each row of ``docs`` (source_file, ...); how many there are.

    For parsed documents, and with ``_chunks`` for ``chunk_documents``. A file is written whole and
    then renamed, so a task that runs again leaves the same files. ``folder`` is one that every
    executor reaches by pyarrow's file systems.
    """
    names = docs.columns
    stem = F.regexp_replace(F.regexp_extract("source_file", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    rows = docs.select(stem.alias("stem"), F.to_json(F.struct(*names), {"pretty": "true", "ignoreNullFields": "false"}).alias("body"))

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for pdf in frames:
            for name, body in zip(pdf["stem"], pdf["body"]):
                draft = f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft, compression=None) as out:
                    out.write(body.encode())
                fs.move(draft, f"{root}/{name}{suffix}.json")
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_chunk_json(spark: SparkSession, folder: str, one_per_document: bool = False) -> DataFrame:
    """A row per chunk; missing lists and metadata read as empty, and what isn't JSON is an error.

    ``one_per_document``: ``*_chunks.json`` files of any layout, one document each; else JSON lines.
    """
    reader = spark.read.schema(CHUNK_JSON).option("mode", "FAILFAST")
    if one_per_document:
        reader = reader.option("multiLine", True).option("pathGlobFilter", "*_chunks.json")
    docs = reader.json(folder)
    rows = docs.select("source_file", F.posexplode(F.coalesce("chunks", F.array().cast("array<struct<content:string,metadata:map<string,string>>>"))).alias("pos", "c"))
    meta = F.coalesce("c.metadata", F.create_map().cast("map<string,string>"))
    return rows.select("source_file", F.col("c.content").alias("content"), *(F.element_at(meta, c).alias(c) for c in _META), F.element_at(meta, "chunk_index").cast("int").alias("chunk_index"), F.element_at(meta, "char_offset").cast("int").alias("char_offset"), meta.alias("metadata"))


# --- store ------------------------------------------------------------------------------------

def store_rows(chunks: DataFrame) -> DataFrame:
    """Columns of the chunk table; the id is a hash of the document and the chunk's index."""
    meta = F.to_json(F.struct(*chunks.drop("content", "embedding", "metadata").columns), {"ignoreNullFields": "false"})
    return chunks.select(F.xxhash64("source_file", "chunk_index").alias("id"), "content", "embedding", *_META, F.col("source_file").alias("source_doc"), "chunk_index", "char_offset", meta.alias("metadata"))


STORED = "id long, content string, embedding array<float>, ticker string, filing_type string, fiscal_period string, section string, source_doc string, chunk_index int, char_offset int, metadata string"
_GONE = "source_doc string"


def store_dimension(spark: SparkSession, folder: str) -> int | None:
    """The vectors' length in the store; None if there is no store."""
    content = Snapshots(spark, folder).read()[1]
    return content and content["dimensions"]


def init_store(spark: SparkSession, folder: str, dimensions: int) -> None:
    """Create the store; one whose vectors have another length is emptied and takes the new length."""
    table = Snapshots(spark, folder)
    if store_dimension(spark, folder) != dimensions:
        table.update(lambda old: old if old and old["dimensions"] == dimensions else {"dimensions": dimensions, "deltas": [], "next": old["next"] if old else 1})


def _checked(rows: DataFrame, dimensions: int) -> DataFrame:
    """``rows``; a vector of another length than the store's is an error when it is read."""
    fits = F.coalesce(F.size("embedding") == dimensions, F.lit(False))
    wrong = F.raise_error(F.lit(f"vectors must have {dimensions} components")).cast(rows.schema["embedding"].dataType)
    named = rows.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(wrong))
    return named.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in _schema(STORED)))


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def _add(table: Snapshots, dimensions: int, rows: str, gone: str | None) -> int:
    def change(old: dict) -> dict:
        if old["dimensions"] != dimensions:
            raise ValueError(f"the store's vectors now have {old['dimensions']} components")
        delta = {"seq": old["next"], "rows": rows, "gone": gone}
        return {**old, "deltas": [*old["deltas"], delta], "next": old["next"] + 1}

    return table.update(change)


def append(rows: DataFrame, folder: str) -> int:
    """Plain insert: rows that are there already come twice. Returns the snapshot that has them."""
    table = Snapshots(rows.sparkSession, folder)
    dimensions, name = table.read()[1]["dimensions"], table.new_data()
    _checked(rows, dimensions).write.parquet(f"{folder}/{name}")
    return _add(table, dimensions, name, None)


def seed(rows: DataFrame, folder: str, documents: DataFrame | None = None) -> int:
    """Put documents' chunks in the store, in place of all it had of them: seeding twice is seeding once.

    ``documents`` (source_doc) names documents that are to be replaced even where ``rows`` has no
    chunk of them. The rows and the documents' names are written beside what is stored, and then
    published together in one snapshot, whose number is returned; nothing stored is rewritten, and
    whoever reads an earlier snapshot goes on reading that. After ``COMPACT_AT`` such writes the
    store is compacted.
    """
    table = Snapshots(rows.sparkSession, folder)
    dimensions, name, gone = table.read()[1]["dimensions"], table.new_data(), table.new_data()
    _checked(rows, dimensions).write.parquet(f"{folder}/{name}")
    docs = rows.sparkSession.read.schema(STORED).parquet(f"{folder}/{name}").select("source_doc")
    if documents is not None:
        docs = docs.unionByName(documents.select(F.col("source_doc").cast("string")))
    docs.distinct().write.parquet(f"{folder}/{gone}")
    version = _add(table, dimensions, name, gone)
    if len(table.read()[1]["deltas"]) > COMPACT_AT:
        compact(rows.sparkSession, folder)
    return version


def _read(spark: SparkSession, folder: str, content: dict | None) -> DataFrame:
    deltas = content["deltas"] if content else []
    if not deltas:
        return spark.createDataFrame([], STORED)
    read = lambda some: spark.read.schema(STORED).parquet(*(f"{folder}/{d['rows']}" for d in some))
    removals = [d for d in deltas if d["gone"] and d["seq"] > deltas[0]["seq"]]
    if not removals:
        return read(deltas)
    # of a document, what is older than its last replacement is gone; what came with the last of all, or later, is not looked for
    older, newer = ([d for d in deltas if (d["seq"] >= removals[-1]["seq"]) == new] for new in (False, True))
    rows = read(older)
    gone = spark.read.schema(_GONE).parquet(*(f"{folder}/{d['gone']}" for d in removals)).select("source_doc", number_of({d["gone"]: d["seq"] for d in removals}).alias("seq"))
    last = gone.groupBy("source_doc").agg(F.max("seq").alias("last")).withColumnRenamed("source_doc", "replaced")
    own = rows.select("*", number_of({d["rows"]: d["seq"] for d in older}).alias("seq"))
    live = own.join(last, F.col("source_doc").eqNullSafe(F.col("replaced")), "left").where(F.col("last").isNull() | (F.col("seq") >= F.col("last")))
    return live.select(*rows.columns).unionByName(read(newer))


def read_store(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The store's rows at a snapshot, by default the last one now; later writes don't touch the result."""
    return _read(spark, folder, Snapshots(spark, folder).read(version)[1])


def compact(spark: SparkSession, folder: str, file_bytes: int = FILE_BYTES) -> bool:
    """Merge what is stored into files of about ``file_bytes``, sorted by document; whether it was published.

    Writes that come meanwhile stay as they are. If another compaction comes first, this one is
    given up.
    """
    table = Snapshots(spark, folder)
    content = table.read()[1]
    merged = content["deltas"] if content else []
    if not merged:
        return False
    name, files = table.new_data(), max(1, -(-table.size([d["rows"] for d in merged]) // file_bytes))
    rows = _read(spark, folder, content)
    rows.repartitionByRange(files, "source_doc", "chunk_index").sortWithinPartitions("source_doc", "chunk_index").write.parquet(f"{folder}/{name}")

    def change(now: dict) -> dict:
        if now["deltas"][:len(merged)] != merged:
            raise Superseded
        return {**now, "deltas": [{"seq": merged[-1]["seq"], "rows": name, "gone": None}, *now["deltas"][len(merged):]]}

    try:
        table.update(change)
    except Superseded:
        return False
    return True


def vacuum(spark: SparkSession, folder: str, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
    """Delete what the last ``keep`` snapshots don't name, once it is ``older_than`` seconds old, so that no writer's work in hand goes."""
    return Snapshots(spark, folder).vacuum(lambda c: [n for d in c["deltas"] for n in (d["rows"], d["gone"]) if n], keep, older_than)


def insert_values(rows: DataFrame) -> DataFrame:
    """Rows of the store as text, vectors as literals, for a database's bulk load."""
    return rows.select(*(vector_literal(F.col(c)).alias(c) if c == "embedding" else F.col(c).cast("string").alias(c) for c in rows.columns))
