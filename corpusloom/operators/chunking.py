"""Splitting sections into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Separators, tried in this order.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters where a separator allows it.

    The first separator that the text has cuts it, and stays at the head of the next piece. Pieces
    fill chunks; a new chunk begins with the last pieces of the one before, up to ``overlap``.
    Pieces that are too long are cut with the separators that follow.
    """
    at = next(k for k, s in enumerate(separators) if s in text or not s)
    sep, finer = separators[at], separators[at + 1:]
    # pieces lie side by side in the text, so places do for them, and a chunk is a slice
    cuts: Sequence[int] = range(len(text) + 1) if not sep else sorted({0, *_places(text, sep), len(text)})
    out: list[str] = []
    first = 0  # of the pieces held

    def emit(end: int) -> None:
        chunk = text[cuts[first]:cuts[end]].strip()
        if chunk:
            out.append(chunk)

    for k in range(len(cuts) - 1):
        if cuts[k + 1] - cuts[k] >= size:
            if first < k:
                emit(k)
            piece = text[cuts[k]:cuts[k + 1]]
            out.extend(split_text(piece, size, overlap, finer) if finer else [piece])
            first = k + 1
        elif cuts[k + 1] - cuts[first] > size and first < k:
            emit(k)
            while first < k and (cuts[k] - cuts[first] > overlap or cuts[k + 1] - cuts[first] > size):
                first += 1
    if first < len(cuts) - 1:
        emit(len(cuts) - 1)
    return out


def _places(text: str, sep: str) -> Iterator[int]:
    at = text.find(sep)
    while at >= 0:
        yield at
        at = text.find(sep, at + len(sep))


def chunk_sections(sections: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """``sections`` (source_file, section_no, text, ...) -> a row per chunk.

    Adds ``content``, ``chunk_index`` (runs across a document's sections) and ``char_offset`` (an
    estimate: lengths before it in its section, each less the overlap).
    """
    # by plain rows: a batch of Arrow's would hold 10,000 sections, and all their chunks
    pieces = F.udf(lambda t: split_text(t or "", size, overlap), "array<string>", useArrow=False)
    rest = [F.col(f"`{f.name}`") for f in sections.schema.fields if f.name != "text"]
    return number_chunks(sections.select(*rest, F.posexplode(pieces(F.col("text"))).alias("pos", "content")), overlap)


def number_chunks(pieces: DataFrame, overlap: int) -> DataFrame:
    """Index and offset estimate of pieces (source_file, section_no, pos, content), as windows."""
    by_doc = Window.partitionBy("source_file").orderBy("section_no", "pos")
    before = Window.partitionBy("source_file", "section_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.greatest(F.length("content") - overlap, F.lit(0))).over(before), F.lit(0))
    return pieces.withColumn("chunk_index", (F.row_number().over(by_doc) - 1).cast("int")).withColumn("char_offset", offset.cast("int"))
