"""WARC archives as a Spark data source: written by Spark's own committed file writer, read by a Python data source.

Writing. A record is one text row, and the row separator is the blank line pair that ends a WARC record, so the files come from Spark's
file writer with its commit protocol, on every file system that Spark reaches. Of equal payloads one is a ``response``, the others are
``revisit`` records that refer to it and carry the HTTP header only.

Reading. The driver lists files and packs them into partitions; a record is parsed header first. Filters on record type and
other header columns are pushed into the reader, which steps over the blocks of records that do not pass, and over all payloads when they are
not asked for. Plain files are stepped over by seeking, compressed ones (one member a record or a file) by reading on.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm.common import written
from meterflow.session import ship_package

FORMAT = "warc"
#: Bytes of files that make up a partition; a larger file is a partition of its own.
PARTITION_BYTES = 128 << 20
#: A record's header may have so many bytes; more means a damaged file.
HEADER_BYTES = 1 << 20
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20

#: Fixed values of the format.
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
HTTP_TYPE = "application/http;msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Header columns and the fields that they come from.
FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in FIELDS],
        T.StructField("content_length", T.LongType()),
        T.StructField("payload_length", T.LongType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)
_ARROW = pa.schema([*[(c, pa.string()) for c in FIELDS], ("content_length", pa.int64()), ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


# -- writing ------------------------------------------------------------------------------------------------------------


def base32_sha1(payload: Column) -> Column:
    """The payload's SHA-1 in bare upper-case base32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def with_revisits(records: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """Adds ``_warc_first``: the smallest identifier of the records with an equal payload of at least ``least_bytes`` bytes, null if alone.

    Payloads are equal by length, SHA-1 and SHA-256. Copies shrink to a row a task before they are shuffled; the few digests that repeat are
    written, so that the join back can split the rows of a very common payload.
    """
    payload = F.col(payload_col)
    name = {"_warc_sha": F.unhex(F.sha2(payload, 256)), "_warc_sha1": F.unhex(F.sha1(payload)), "_warc_bytes": F.octet_length(payload).cast("long")}
    named = records.withColumns(name)
    same = named.where(F.col("_warc_bytes") >= least_bytes).groupBy(*name).agg(F.min(id_col).alias("_warc_first"), F.count("*").alias("n"))
    repeated = written(same.where(F.col("n") > 1).drop("n"), "repeated-payloads")
    return named.join(repeated, list(name), "left").drop("_warc_sha", "_warc_sha1")


def warc_rows(records: DataFrame, id_col: str, uri_col: str, payload_col: str, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """One ``value`` per record: its header and block without the line pair that ends it."""
    taken = records.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = with_revisits(taken, "id", "payload", least_bytes)
    again = F.col("_warc_first").isNotNull() & ~F.col("id").eqNullSafe(F.col("_warc_first"))
    urn = lambda c: F.concat(F.lit("<urn:row:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    uri = F.col("uri")
    for raw, encoded in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        uri = F.replace(uri, F.lit(raw), F.lit(encoded))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_warc_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, F.col("payload").cast("string")))
    line = lambda name, value: F.concat(F.lit(f"{CRLF}{name}: "), value)
    header = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        F.when(F.col("again"), F.concat(line("WARC-Refers-To", urn("_warc_first")), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit(HTTP_TYPE)),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF * 2),
    )
    return rows.withColumn("again", again).withColumn("block", block).select(F.concat(header, F.col("block")).alias("value"))


def write_warc(
    records: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = DATE, compression: str = "none", file_records: int = 0
) -> None:
    """The records as WARC 1.1 files in a new folder, at most ``file_records`` in one (0: a file per task).

    Record identifiers are ``urn:row:`` and the row's. Of records with equal payloads of at least ``least_bytes`` bytes, the one of the
    smallest identifier is a response, the others revisit it; rows that share that identifier are responses all, as are copies that all lack
    one. A null payload is empty, a record without address has no such field; white space in an address is percent-encoded. An
    empty table gives a folder without records.
    """
    rows = warc_rows(records, id_col, uri_col, payload_col, least_bytes, date)
    rows.write.option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", file_records).text(path)


# -- reading ------------------------------------------------------------------------------------------------------------


class DamagedArchive(ValueError):
    """A file that is not WARC, or ends inside a record."""


def _header(file: BinaryIO, first: bytes, at: str) -> dict[str, str]:
    """The named fields of a header whose version line has been read; repeated fields are joined, folded lines unfolded."""
    if not first.startswith(b"WARC/"):
        raise DamagedArchive(f"no record where one should begin: {at}")
    fields: dict[str, str] = {}
    name, size = None, 0
    while line := file.readline(HEADER_BYTES):
        size += len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return fields
        if size >= HEADER_BYTES:
            break
        if text[0] in " \t" and name:
            fields[name] += " " + text.strip()
            continue
        key, colon, value = text.partition(":")
        name = key.strip().lower()
        fields[name] = f"{fields[name]}, {value.strip()}" if name in fields else value.strip()
    raise DamagedArchive(f"a header does not end: {at}")


def _skip(file: BinaryIO, size: int, seekable: bool) -> None:
    if seekable:
        file.seek(size, io.SEEK_CUR)
        return
    while size > 0:
        step = len(file.read(min(size, 1 << 20)))
        if not step:
            raise DamagedArchive("a file ends inside a record")
        size -= step


def _whole(file: BinaryIO, size: int) -> bytes:
    data = file.read(size)
    if len(data) < size:
        raise DamagedArchive("a file ends inside a record")
    return data


def _http_header(file: BinaryIO, size: int) -> tuple[int, int | None]:
    """Bytes of the HTTP header at the start of a block of ``size`` bytes, and the body length that it states."""
    read, stated = 0, None
    while read < size:
        line = file.readline(min(size - read, HEADER_BYTES))
        if not line:
            raise DamagedArchive("a file ends inside a record")
        read += len(line)
        if not line.strip(b"\r\n"):
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            stated = int(value)
    return read, stated


def read_records(file: BinaryIO, wanted: Callable[[dict[str, Any]], bool], payload: bool, seekable: bool, at: str = "") -> Iterator[dict[str, Any]]:
    """The records of an open file that are wanted by their headers; payloads only if asked for."""
    while first := file.readline(HEADER_BYTES):
        if not first.strip():
            continue  # the lines between two records
        fields = _header(file, first.strip(), at)
        try:
            size = int(fields["content-length"])
        except (KeyError, ValueError):
            raise DamagedArchive(f"a record without length: {at}") from None
        row: dict[str, Any] = {c: fields.get(f) for c, f in FIELDS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else row[c]
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2] if row["payload_digest"] else None
        row |= {"content_length": size, "headers": fields}
        if not wanted(row):
            _skip(file, size, seekable)
            continue
        read, stated = _http_header(file, size) if (row["content_type"] or "").startswith("application/http") else (0, None)
        row["payload_length"] = size - read if stated is None else stated
        row["payload"] = None
        if payload and row["record_type"] != "revisit":
            row["payload"] = _whole(file, size - read)
        else:
            _skip(file, size - read, seekable)
        yield row


#: Filters on header columns and what they compare.
_TESTS: dict[type, Callable[[Any, Any], bool]] = {
    D.EqualTo: lambda v, f: v == f.value,
    D.EqualNullSafe: lambda v, f: v == f.value,
    D.GreaterThan: lambda v, f: v > f.value,
    D.GreaterThanOrEqual: lambda v, f: v >= f.value,
    D.LessThan: lambda v, f: v < f.value,
    D.LessThanOrEqual: lambda v, f: v <= f.value,
    D.In: lambda v, f: v in f.value,
    D.StringStartsWith: lambda v, f: v.startswith(f.value),
    D.StringEndsWith: lambda v, f: v.endswith(f.value),
    D.StringContains: lambda v, f: f.value in v,
    D.IsNull: lambda v, f: v is None,
    D.IsNotNull: lambda v, f: v is not None,
}
_OF_NULL = (D.EqualNullSafe, D.IsNull, D.IsNotNull)
COMPARED = {*FIELDS, "content_length"}


def understood(test: D.Filter) -> bool:
    if isinstance(test, D.Not):
        return understood(test.child)
    return type(test) in _TESTS and len(test.attribute) == 1 and test.attribute[0] in COMPARED


def passes(row: dict[str, Any], test: D.Filter) -> bool | None:
    """Whether a header passes; ``None`` where SQL says null, which a negation leaves null."""
    if isinstance(test, D.Not):
        inner = passes(row, test.child)
        return None if inner is None else not inner
    value = row[test.attribute[0]]
    if value is None and type(test) not in _OF_NULL:
        return None
    return _TESTS[type(test)](value, test)


@dataclass
class Files(D.InputPartition):
    """Files that one task reads."""

    paths: list[str]


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def packed(files: list[tuple[str, int]], limit: int) -> list[Files]:
    """Files in order, together up to ``limit`` bytes a partition."""
    parts: list[list[str]] = []
    room = 0
    for path, size in files:
        if not parts or size > room:
            parts.append([])
            room = limit
        parts[-1].append(path)
        room -= size
    return [Files(p) for p in parts]


class WarcReader(D.DataSourceReader):
    def __init__(self, path: str, payload: bool, limit: int):
        self.path, self.payload, self.limit, self.filters = path, payload, limit, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for test in filters:
            if understood(test):
                self.filters.append(test)
            else:
                yield test

    def partitions(self) -> list[Files]:
        system, root = _open_fs(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(part[:1] in ("_", ".") for part in p.removeprefix(root).split("/") if part)
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not hidden(f.path))
        return packed(files, self.limit) or [Files([])]

    def _wanted(self, row: dict[str, Any]) -> bool:
        return all(passes(row, test) for test in self.filters)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open_fs(self.path)
        rows: list[dict[str, Any]] = []
        size = 0
        for path in partition.paths:
            with system.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 18) as plain:
                packed_up = plain.peek(2)[:2] == b"\x1f\x8b"
                file = io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 18) if packed_up else plain
                for row in read_records(file, self._wanted, self.payload, not packed_up, path):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 1000
                    if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    columns = [pa.array([list(r[f.name].items()) if f.name == "headers" else r[f.name] for r in rows], f.type) for f in _ARROW]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class WarcSource(D.DataSource):
    """``spark.read.format("warc").load(folder or file)``; options ``payload`` (true) and ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        payload = str(self.options.get("payload", "true")).lower() == "true"
        return WarcReader(self.options["path"], payload, int(self.options.get("partition_bytes", PARTITION_BYTES)))


def read_warc(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Records of the WARC files in a folder, or of one file: header columns, all ``headers`` (lower-case names), ``payload``.

    ``payload_length`` is the length that the HTTP header states, else that of the block; ``payload`` is null for revisit records, and for all if it is not
    asked for. Filters on header columns reach the reader. A damaged file fails the job. A folder without records gives an empty result.
    """
    ship_package(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).option("payload", payload).option("partition_bytes", partition_bytes).load(path)
