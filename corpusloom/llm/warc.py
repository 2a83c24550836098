"""WARC archives as a Spark data source: ``format("warc")`` for reading and writing.

Files are ``.warc`` or ``.warc.gz`` with one gzip member per record. A partition is a run of
files; files are never cut, since a record can hold any bytes, record headers included. The
writer rolls files at a bounded size. Reading goes record by record: headers first; a record that
the pushed predicates reject, or whose payload isn't asked for, is passed over: by a jump in plain
files and in gzip members that tell their length, as the writer's do, else by inflating it. Paths are any that pyarrow's file systems open (file, s3, gs, hdfs).
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ._common import column_type, materialise, possibly, scratch_path

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
_HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: A file is closed when it has grown past this; a partition takes files up to about as much.
ROLL_BYTES = 64 << 20
_READ = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are written in full each time.
REVISIT_FROM = 100


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# --- records ----------------------------------------------------------------------------------

def encode_record(row: dict) -> bytes:
    """One record: an HTTP response, or a revisit that names the record with the same payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date']}"]
    if row.get("target_uri") is not None:
        head.append("WARC-Target-URI: " + " ".join(row["target_uri"].split("\n")).replace("\r", " "))
    head.append(f"WARC-Payload-Digest: {row['payload_digest']}")
    if revisit:
        head += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Extra field of a gzip member that holds one record: the member's length, so that it can be passed over.
_LENGTH = struct.Struct("<HccHQ")
_MEMBER = 10 + _LENGTH.size


def _gzip(data: bytes) -> bytes:
    """A gzip member that tells its own length; any reader of gzip reads it."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    extra = _LENGTH.pack(_LENGTH.size - 2, b"W", b"L", 8, _MEMBER + len(body) + 8)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Bytes:
    """Bytes of a plain or gzipped stream, bounded in memory; reads over gzip members alike."""

    def __init__(self, stream, gz: bool):
        self.stream, self.gz, self.held = stream, gz, bytearray()
        #: the member that is being read, where it ends if it says so, and bytes read ahead
        self.member, self.end, self.raw, self.read = None, None, b"", 0

    def _fill(self, n: int) -> bool:
        """Read ahead until there are n bytes, or as many as are left."""
        while len(self.raw) < n:
            data = self.stream.read(_READ)
            if not data:
                break
            self.raw += data
            self.read += len(data)
        return bool(self.raw)

    def _more(self) -> bool:
        if not self.gz:
            if not self._fill(1):
                return False
            self.held += self.raw
            self.raw = b""
            return True
        while self._fill(1):
            if self.member is None:
                self._fill(_MEMBER)
                self.member, self.end = zlib.decompressobj(31), None
                if self.raw[3:4] == b"\x04" and len(self.raw) >= _MEMBER:
                    _, a, b, size, length = _LENGTH.unpack(self.raw[10:_MEMBER])
                    if (a, b, size) == (b"W", b"L", 8):
                        self.end = self.read - len(self.raw) + length
            # little at first: a record's headers decide whether the rest is wanted
            data = self.member.decompress(self.raw, _READ * 4 if self.held else 2048)
            self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
            if data:
                self.held += data
                return True
        return False

    def line(self) -> bytes | None:
        at = 0
        while (k := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if not self._more():
                out, self.held = bytes(self.held), bytearray()
                return out or None
        out = bytes(self.held[:k + 1])
        del self.held[:k + 1]
        return out

    def take(self, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            if not self.held and not self._more():
                raise EOFError("a record ends early")
            part = min(n - len(out), len(self.held))
            out += self.held[:part]
            del self.held[:part]
        return bytes(out)

    def skip(self, n: int) -> None:
        """Pass over n bytes, the rest of a record: by a jump where the place is known, else by reading."""
        if self.gz and self.member is not None and self.end is not None:
            self._jump(self.end)
            self.member, self.held = None, bytearray()
            return
        part = min(n, len(self.held))
        del self.held[:part]
        n -= part
        if n and not self.gz:
            self._jump(self.read - len(self.raw) + n)
            return
        while n:
            if not self.held and not self._more():
                raise EOFError("a record ends early")
            part = min(n, len(self.held))
            del self.held[:part]
            n -= part

    def _jump(self, place: int) -> None:
        ahead = place - (self.read - len(self.raw))
        if ahead > len(self.raw):
            if place > self.stream.seek(0, 2):
                raise EOFError("a record ends early")
            self.stream.seek(place)
            self.raw, self.read = b"", place
        else:
            self.raw = self.raw[ahead:]


def _headers(src: _Bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    while (line := src.line()) not in (None, b"\r\n", b"\n"):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:  # a folded header
            out[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def records(stream, gz: bool, wanted, with_payload: bool) -> Iterator[dict]:
    """Records that ``wanted(fields)`` accepts, with payloads only where they are asked for."""
    src = _Bytes(stream, gz)
    while True:
        while (line := src.line()) in (b"\r\n", b"\n"):
            pass
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _headers(src)
        row = {k: head.get(v) for k, v in _HEADER.items()}
        for k in ("record_id", "refers_to"):
            row[k] = row[k].strip("<>") if row[k] else row[k]
        length = int(head.get("content-length", 0))
        if not wanted(row):
            src.skip(length)
            continue
        if not head.get("content-type", "").startswith("application/http"):
            block = src.take(length) if with_payload else src.skip(length)
            yield row | {"payload_bytes": length, "payload": block}
            continue
        http = bytearray()
        size = None
        while len(http) < length:
            one = src.line() or b""
            http += one
            if one.lower().startswith(b"content-length:"):
                size = int(one.split(b":", 1)[1])
            if one in (b"\r\n", b"\n", b""):
                break
        body = length - len(http)
        revisit = row["record_type"] == "revisit"
        payload = src.take(body) if with_payload and not revisit else src.skip(body)
        yield row | {"payload_bytes": size if revisit and size is not None else body, "payload": payload}


# --- data source ------------------------------------------------------------------------------

class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        """Spark doesn't prune a Python source's columns: ``option("payload", "false")`` leaves payloads out."""
        return SCHEMA if self.options.get("payload", "true") == "true" else SCHEMA.removesuffix(", payload binary")

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip", int(self.options.get("rollBytes", ROLL_BYTES)), overwrite)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, [f.name for f in schema.fields]
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes equality, IN and prefix tests of header fields; gives back all others."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in _HEADER and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in _HEADER and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in _HEADER and isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", (f.value,)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None and (row[c] in values if kind == "in" else row[c].startswith(values[0])) for c, kind, values in self.tests)

    def partitions(self) -> list[Files]:
        fs, root = _open(self.path)
        infos = [fs.get_file_info(root)]
        if infos[0].type == pafs.FileType.Directory:
            manifests = _manifests(fs, root)
            if manifests:
                infos = fs.get_file_info([f"{root}/{n}" for m in manifests for n in _listed(fs, m)])
            else:
                infos = [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        elif infos[0].type != pafs.FileType.File:
            raise FileNotFoundError(self.path)
        out, held = [Files([])], 0
        for x in sorted(infos, key=lambda x: x.path):
            if held and held + x.size > ROLL_BYTES:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(x.path)
            held += x.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = _open(self.path)
        with_payload = "payload" in self.names
        for path in partition.paths:
            with fs.open_input_file(path) as stream:
                for row in records(stream, path.endswith(".gz"), self.wanted, with_payload):
                    yield tuple(row.get(n) for n in self.names)


def _manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    return [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if re.fullmatch(r"_manifest-\w+\.json", x.base_name)]


def _listed(fs: pafs.FileSystem, manifest: str) -> list[str]:
    with fs.open_input_stream(manifest) as f:
        return json.loads(f.readall())


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each attempt writes files of its own; each commit adds a manifest that names those that count."""

    def __init__(self, path: str, gz: bool, roll: int, overwrite: bool = False):
        self.path, self.gz, self.roll, self.overwrite = path, gz, roll, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gz)
                    out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = encode_record({c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)})
                data = _gzip(data) if self.gz else data
                out.write(data)
                size += len(data)
                if size >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        old = _manifests(fs, root) if self.overwrite else []
        gone = [n for m in old for n in _listed(fs, m)]
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        for path in [*old, *(f"{root}/{n}" for n in gone)]:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            for n in m.names if m else ():
                fs.delete_file(f"{root}/{n}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- operator ---------------------------------------------------------------------------------

def to_records(df: DataFrame, id_col: str, uri_col: str, body_col: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Rows of ``SCHEMA``: of equal payloads the smallest id is the response, others revisit it.

    A null body is an empty payload. Ids are taken to be unique; a null id is written as the
    record ``urn:row:`` and is never referred to. Rows with one id and payload are all responses.
    """
    body = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "utf-8")
    rows = df.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("target_uri"), body.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    key = ["digest", "payload_bytes"]
    long = rows.where(F.col("payload_bytes") >= revisit_from).select("id", *key)
    first = materialise(long.groupBy(*key).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    # payloads that nothing repeats stay out of the shuffle, and so do those of revisits, which need none
    maybe, rest = possibly(rows, first, key)
    name = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    bare = maybe.drop("payload").join(first.hint("merge"), key, "left")
    bare = materialise(bare.withColumn("again", F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull())), "judged")
    whole = materialise(bare.where("not again").select(name.alias("name"), *key).distinct(), "responses")
    held, _ = possibly(maybe.withColumn("name", name), whole, ["name", *key])
    held = held.join(whole.hint("merge"), ["name", *key]).select(*rows.columns)
    none = F.lit(None).cast(first.schema["first"].dataType)
    revisits = bare.where("again").withColumn("payload", F.lit(None).cast("binary")).select(*rows.columns, "first", "again")
    known = rest.unionByName(held).withColumns({"first": none, "again": F.lit(False)}).unionByName(revisits)
    again = F.col("again")
    urn = lambda c: F.concat(F.lit("urn:row:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return known.select(
        urn("id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lit("2000-01-01T00:00:00Z").alias("date"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, urn("first")).alias("refers_to"), "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(df: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> None:
    """Write one record per row under ``path``."""
    register(df.sparkSession)
    to_records(df, id_col, uri_col, body_col).write.format("warc").mode("append").save(path)


def archived(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write the rows as WARC into the shared folder and read the archives back.

    Returns one row per input row: the id column, ``payload_bytes``, ``payload_digest`` (of the
    full payload: computed anew for responses, from the header for revisits), ``record_type``,
    ``refers_to``. Empty tables give an empty result; other columns play no part.
    """
    spark, kind = df.sparkSession, column_type(df, id_col)
    path = scratch_path(spark, "warc")
    archive(df, path, id_col, uri_col, body_col)
    read = spark.read.format("warc").load(path)
    number = lambda c: F.nullif(F.substring(F.col(c), len("urn:row:") + 1, 1000), F.lit("")).cast(kind)
    whole = F.sha2("payload", 256)
    return read.select(
        number("record_id").alias(id_col), "payload_bytes", F.when(F.col("record_type") == "revisit", F.substring("payload_digest", 8, 64)).otherwise(whole).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )
