"""New filings as a stream into the chunk store."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..jobs.pipeline import chunk_filings
from ..operators.dense import Embedder, embed
from ..sources import filings_source
from ..sources.store import init_store, seed, store_rows


def follow(spark: SparkSession, folder: str, store: str, checkpoint: str, embedder: Embedder, settings: Settings = Settings()) -> StreamingQuery:
    """Seed each file that appears in ``folder`` or changes there; a batch that runs again replaces what it wrote."""
    filings_source.register(spark)
    pages = spark.readStream.format("filings").load(folder).select("source_file", "html")

    def put(batch, _):
        init_store(batch.sparkSession, store, settings.embedding_dimensions)
        rows = store_rows(embed(chunk_filings(batch, settings), embedder, batch=settings.embedding_batch_size))
        seed(rows, store, batch.select(F.col("source_file").alias("source_doc")))

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
