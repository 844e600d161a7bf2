"""WARC archives as a PySpark Python data source, and revisit records for repeated payloads.

``register(spark)`` makes format "warc" known. Reading plans one partition per range of compressed bytes (ranges start
anew at the next gzip member), pushes predicates on record type and header columns down to the reader, parses each
record's headers first, and neither inflates nor decodes the payload of a record that fails them or when the schema
asked for has no ``payload``. Writing makes one gzip member per record; the member's length is stored in a gzip extra
field, so that a reader can step over it. Each write's files become visible by a manifest that the driver adds on
commit; a reader takes the files of all manifests, so appended files are read too, and those of failed or repeated
task attempts never are. Overwriting adds the new manifest and then deletes the former ones with their files.

Defined results: a null payload is written as an empty one; null header values are left out and read back as null;
an empty table makes archives without records; line breaks in header values become spaces. A record whose header has
no end, no WARC version line or a length that is no number is malformed: it is an error, or left out with the option
``mode`` DROPMALFORMED.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull,
    StringStartsWith, WriterCommitMessage,
)

from strataspan.llm.common import bounded, shared_dir, table

HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length",
}
SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c == "payload_bytes" else T.StringType()) for c in HEADERS] + [T.StructField("payload", T.BinaryType())])
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ROLL_BYTES, SPLIT_BYTES, BATCH_BYTES = 256 << 20, 32 << 20, 8 << 20
MANIFEST = "_warc_manifest-"
EPOCH = "1970-01-01T00:00:00Z"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def manifests(fs: pafs.FileSystem, path: str) -> list[str]:
    """The manifests in a folder, one for each write that was committed."""
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(x.path for x in found if x.type == pafs.FileType.File and x.base_name.startswith(MANIFEST))


def read_manifest(fs: pafs.FileSystem, name: str) -> list[str]:
    with fs.open_input_stream(name) as f:
        return json.loads(f.read())


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- one record <-> one gzip member


def member(data: bytes) -> bytes:
    """A gzip member whose extra field 'LN' holds its whole length."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, b"LN", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(values: dict) -> bytes:
    """A record in WARC/1.1; a revisit has no payload."""
    full = values["record_type"] == "response"
    block = HTTP + (values.get("payload") or b"") if full else (HTTP if values["record_type"] == "revisit" else values.get("payload") or b"")
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        v = values.get(column)
        if v is not None:
            v = " ".join(str(v).splitlines())
            lines.append(f"{name}: " + (f"<{v}>" if column in ("record_id", "refers_to") else f"sha1:{v}" if column == "payload_digest" else v))
    if values["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"Content-Type: {'application/warc-fields' if values['record_type'] == 'warcinfo' else 'application/http; msgtype=response'}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Malformed(ValueError):
    pass


def parse_head(data: bytes) -> tuple[dict, int, int]:
    """(columns, where the block starts, its length) of a record; :class:`Malformed` where the header is not whole."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        raise Malformed(f"not a WARC header: {data[:60]!r}")
    found = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        found[k.strip().lower()] = v.strip()
    out = {c: found.get(n.lower()) for c, n in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c] and out[c].removeprefix("<").removesuffix(">")
    out["payload_digest"] = out["payload_digest"] and out["payload_digest"].removeprefix("sha1:")
    for length in (out["payload_bytes"], found.get("content-length")):
        if length and not length.isdecimal():
            raise Malformed(f"not a length: {length[:60]!r}")
    out["payload_bytes"] = int(out["payload_bytes"]) if out["payload_bytes"] else None
    return out, end + 4, int(found.get("content-length") or 0)


class Members:
    """Reads the gzip members that start in a byte range, header first."""

    def __init__(self, stream, size: int, start: int, end: int, chunk: int = 1 << 20, strict: bool = True):
        self.f, self.size, self.at, self.end, self.chunk, self.strict = stream, size, start, end, chunk, strict
        self.base, self.buf = start, b""

    def _need(self, at: int, n: int) -> bytes:
        """Bytes [at, at+n) or what the file has of them."""
        if at < self.base or at + n > self.base + len(self.buf):
            self.f.seek(at)
            self.base, self.buf = at, self.f.read(max(n, self.chunk))
        return self.buf[at - self.base : at - self.base + n]

    def _begins(self, at: int) -> bool:
        head = self._need(at, 20)
        if head[:3] != b"\x1f\x8b\x08":
            return False
        if len(head) == 20 and head[3] & 4 and head[12:14] == b"LN":
            after = at + struct.unpack("<I", head[16:20])[0]
            return after == self.size or self._need(after, 3) == b"\x1f\x8b\x08"
        try:
            return zlib.decompressobj(31).decompress(self._need(at, 4096), 5) == b"WARC/"
        except zlib.error:
            return False

    def seek_member(self) -> None:
        """Move to the first member that starts at or after the range's start."""
        while self.at < min(self.end, self.size):
            window = self._need(self.at, self.chunk)
            k = window.find(b"\x1f\x8b\x08")
            if k < 0:
                self.at += max(1, len(window) - 2)
            elif self._begins(self.at + k):
                self.at += k
                return
            else:
                self.at += k + 1

    def __iter__(self) -> Iterator[tuple[dict, object]]:
        """(header columns, function giving the block). The block is inflated only when asked for."""
        self.seek_member()
        while self.at < self.end and self.at < self.size:
            head = self._need(self.at, 20)
            known = struct.unpack("<I", head[16:20])[0] if head[3] & 4 and head[12:14] == b"LN" else 0
            z, data, at = zlib.decompressobj(31), b"", self.at
            while b"\r\n\r\n" not in data and not z.eof:
                if z.unconsumed_tail:
                    data += z.decompress(z.unconsumed_tail, 4096)
                else:
                    piece = self._need(at, min(1 << 14, known - (at - self.at)) if known else 1 << 14)
                    if not piece:
                        break
                    at += len(piece)
                    data += z.decompress(piece, 4096)
            state = {"z": z, "at": at, "data": data}
            try:
                columns, begin, length = parse_head(data)
            except Malformed:
                if self.strict:
                    raise
                columns, begin, length = None, 0, 0

            def block(state=state, begin=begin, length=length):
                z, got = state["z"], [state["data"]]
                have = len(state["data"])
                while have < begin + length and not z.eof:
                    piece = z.unconsumed_tail or self._need(state["at"], 1 << 16)
                    if not piece:
                        break
                    if not z.unconsumed_tail:
                        state["at"] += len(piece)
                    more = z.decompress(piece, 1 << 20)
                    got.append(more)
                    have += len(more)
                return b"".join(got)[begin : begin + length]

            if columns is not None:
                yield columns, block
            if known:
                self.at += known
            else:  # a foreign archive: the member's end is found by inflating it
                while not z.eof:
                    piece = z.unconsumed_tail or self._need(state["at"], 1 << 16)
                    if not piece:
                        break
                    if not z.unconsumed_tail:
                        state["at"] += len(piece)
                    z.decompress(piece, 1 << 20)
                self.at = state["at"] - len(z.unused_data)


# ---- data source


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__(self.path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _accepts(f: Filter):
    """A predicate on header columns, or None where a filter is not understood."""
    column = getattr(f, "attribute", ("",))[0]
    if column not in HEADERS or len(f.attribute) != 1:
        return None
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return lambda h: h[column] == f.value
    if isinstance(f, In):
        return lambda h: h[column] in f.value
    if isinstance(f, IsNotNull):
        return lambda h: h[column] is not None
    if isinstance(f, IsNull):
        return lambda h: h[column] is None
    if isinstance(f, StringStartsWith):
        return lambda h: h[column] is not None and h[column].startswith(f.value)
    return None


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.uri = [x.name for x in schema], options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.strict = options.get("mode", "FAILFAST").upper() != "DROPMALFORMED"
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if _accepts(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        fs, path = filesystem(self.uri)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.Directory:
            listed = manifests(fs, path)
            if listed:
                files = [fs.get_file_info(f"{path}/{x}") for m in listed for x in read_manifest(fs, m)]
            else:
                files = [x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.path.endswith(".warc.gz")]
        else:
            files = [info]
        return [Range(x.path, at, min(at + self.split, x.size)) for x in files for at in range(0, x.size, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.path:
            return
        fs, _ = filesystem(self.uri)
        tests = [_accepts(f) for f in self.filters]
        wants = "payload" in self.names
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n in self.names])
        rows: list[dict] = []
        size = 0
        with fs.open_input_file(part.path) as f:
            for head, block in Members(f, f.size(), part.start, part.end, strict=self.strict):
                if head["record_type"] == "warcinfo" and not tests or not all(t(head) for t in tests):
                    continue
                if wants:
                    body = block()
                    if head["record_type"] == "revisit":
                        head["payload"] = None
                    else:
                        at = body.find(b"\r\n\r\n") + 4 if head["record_type"] == "response" and body.startswith(b"HTTP/") else 0
                        head["payload"] = body[at:]
                        size += len(body)
                rows.append(head)
                if size >= BATCH_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        fs, path = filesystem(self.uri)
        fs.create_dir(path, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for values in batch.to_pylist():
                if out is None or size >= ROLL_BYTES:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(f"{path}/{files[-1]}", compression=None)
                    out.write(first := member(record({"record_type": "warcinfo", "warc_date": EPOCH, "payload": b"format: WARC File Format 1.1\r\n"})))
                    size = len(first)
                data = member(record({"warc_date": EPOCH, **values}))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        fs, path = filesystem(self.uri)
        fs.create_dir(path, recursive=True)
        former = manifests(fs, path) if self.overwrite else []
        with fs.open_output_stream(f"{path}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())
        for m in former:
            files = read_manifest(fs, m)
            fs.delete_file(m)
            for x in files:
                fs.delete_file(f"{path}/{x}")

    def abort(self, messages):
        fs, path = filesystem(self.uri)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(f"{path}/{x}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---- revisits


def _base32(hex_digest: Column) -> Column:
    """Base32 of 40 hex digits, five digits to four characters."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substring(hex_digest, g * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    chars = F.transform(groups, lambda v: F.concat(*[
        F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]))
    return F.array_join(chars, "")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """WARC rows: of equal payloads of at least ``min_bytes`` bytes that with the largest id is the response.

    Digests and largest ids are counted with partial aggregation; only digests that occur twice or more are joined
    back. They are joined by digest and length, for which the counts need an exchange of their own: so the adaptive skew
    join can split a payload that many pages share. Rows with the largest id twice are both
    responses; a null id is smaller than any id, and is a response when no page with an id has its payload.
    """
    rows = bounded(pages).select(
        F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    counted = rows.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("id").alias("first"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    twice = counted.where("n > 1 AND first IS NOT NULL").drop("n")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(twice, ["sha", "size"], "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("urn:page:"), F.col("id").cast("string")).alias("record_id"), "target_uri",
        F.when(again, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        _base32(F.col("sha")).alias("payload_digest"), F.col("size").cast("long").alias("payload_bytes"),
        F.when(~again, F.col("payload")).alias("payload"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = shared_dir(spark)
    with_revisits(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return back.select(
        number("record_id").alias("page_id"),
        F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(x, CAST(k // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM q
"""
