"""Parsing filings: metadata, section slices and clean text."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import last_places, strip_u

# Section markers, metadata patterns, tags that break paragraphs.
_GAP = r"(?:&nbsp;|\s++)*"
SECTIONS = (
    ("Item 1A Risk Factors", rf"Item\s*1A\s*\.{_GAP}Risk Factors", rf"Item\s*1B\s*\.{_GAP}Unresolved"),
    ("Item 7 MD&A", rf"Item\s*7\s*\.{_GAP}Management", r"Item\s*7A\s*\."),
)
TYPE, FILENAME = r"(?i)<type>\s*([^<\n]+)", r"(?i)<filename>\s*([^<\n]+)"
FORM = r"(?i)(10-?[KQ]|8-[KQ])"
YEAR_TAG = r"(?iU)DocumentFiscalYearFocus[^>]*>\s*(\d{4})\s*<"
YEAR_COVER = rf"(?iU)fiscal year ended{_GAP}[A-Za-z]+{_GAP}\d{{1,2}},{_GAP}(\d{{4}})"
BREAKS = frozenset(("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


def decode_bytes(data: bytes) -> str:
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


class _Paragraphs(HTMLParser):
    """Text nodes by paragraph. Comments and script bodies count as text nodes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[str] = []
        self.held: list[str] = []
        self.open: list[str] = []

    def cut(self) -> None:
        text = " ".join(" ".join(self.held).split())
        self.held = []
        if text:
            self.done.append(text)

    def node(self, data: str) -> None:
        if text := data.replace(" ", " ").strip():
            self.held.append(text)

    handle_data = handle_comment = node

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS:
            self.cut()
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while (last := self.open.pop()) != tag:
            if last in BREAKS:
                self.cut()
        if tag in BREAKS:
            self.cut()


def clean_html(fragment: str) -> str:
    p = _Paragraphs()
    p.feed(fragment)
    p.close()
    p.cut()
    return "\n\n".join(p.done)


# By plain rows, a hundred at a time: a batch of Arrow's has 10,000 pages, whole files in Python's memory.
clean_text = F.udf(lambda x: None if x is None else clean_html(x), StringType(), useArrow=False)
decode_html = F.udf(lambda x: None if x is None else decode_bytes(bytes(x)), StringType(), useArrow=False)


def section_slices(html: Column, markers: list[tuple[str, str]]) -> Column:
    """Of each (start, end) the struct (raw, char_offset) from the last start to the last end; null if none. One pass for all.

    Without an end marker the slice runs to the end; one before the start leaves no section.
    """

    def cut(places: Column, k: int) -> Column:
        a, b = places[2 * k], F.coalesce(places[2 * k + 1], F.length(html))
        return F.when(b > a, F.struct(F.substring(html, a + 1, b - a).alias("raw"), a.alias("char_offset")))

    # through an array of one, so that the places are found once for all that use them
    found = F.array(last_places(html, [m for pair in markers for m in pair]))
    return F.transform(found, lambda places: F.array(*(cut(places, k) for k in range(len(markers)))))[0]


def section_slice(html: Column, start: str, end: str) -> Column:
    return section_slices(html, [(start, end)])[0]


def matched(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), strip_u(F.regexp_extract(c, pattern, 1)))


def ticker(filename: Column) -> Column:
    name = F.regexp_extract(filename, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(strip_u(F.substring_index(stem, "-", 1)), F.lit("")), F.lit("unknown"))


def form_of_name(name: Column) -> Column:
    form = F.upper(F.regexp_extract(name, FORM, 1))
    return F.when(name.rlike(FORM), F.regexp_replace(form, r"(10|8)K$", "$1-K"))


def fiscal_period(html: Column) -> Column:
    year = F.coalesce(*(F.when(html.rlike(p), F.regexp_extract(html, p, 1)) for p in (YEAR_TAG, YEAR_COVER)))
    return F.concat(F.lit("FY"), year)


def parse(files: DataFrame) -> DataFrame:
    """``files`` (source_file, html) -> a row per document with metadata, sections and warnings."""
    html, name = F.col("html"), F.regexp_extract("source_file", r"([^/]*)$", 1)
    kind, filename = F.coalesce(matched(html, TYPE), F.lit("UNKNOWN")), matched(html, FILENAME)
    own = ticker(F.coalesce(filename, F.lit("")))
    meta = files.select(
        "source_file", "html", F.when(own == "unknown", ticker(name)).otherwise(own).alias("ticker"),
        F.when(kind == "UNKNOWN", F.coalesce(form_of_name(name), F.lit("UNKNOWN"))).otherwise(kind).alias("filing_type"),
        fiscal_period(html).alias("fiscal_period"), filename.alias("filename"))
    meta = meta.withColumn("slices", section_slices(html, [(start, end) for _, start, end in SECTIONS]))
    meta = meta.withColumns({f"s{k}": F.col("slices")[k] for k in range(len(SECTIONS))})
    for k, _ in enumerate(SECTIONS):
        meta = meta.withColumn(f"t{k}", clean_text(F.col(f"s{k}.raw")))
    some = F.array(*(F.when(F.col(f"s{k}").isNotNull(), F.struct(F.lit(label).alias("section"), F.col(f"t{k}").alias("text"), F.col(f"s{k}.char_offset").alias("char_offset"), F.regexp_count(f"t{k}", F.lit(r"(?U)\S+")).alias("word_count"))) for k, (label, _, _) in enumerate(SECTIONS)))
    missing = F.array(*(F.when(F.col(f"s{k}").isNull(), F.lit(f"Section '{label}' could not be extracted")) for k, (label, _, _) in enumerate(SECTIONS)))
    present = lambda c: F.filter(c, lambda x: x.isNotNull())
    return meta.select("source_file", "ticker", "filing_type", "fiscal_period", "filename", present(missing).alias("warnings"), present(some).alias("sections"))
