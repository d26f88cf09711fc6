"""A data source for WARC archives, and archiving of pages with revisit records for equal payloads.

Reading: one partition for each group of files; record types and headers named in filters are pushed down and tested on
the parsed header, before the record's block is touched. Blocks that aren't wanted are skipped by seeking (plain files) or
inflated past without decoding (one gzip member for each record). Writing: each task writes files of its own with new names; a
manifest written on commit names the files that count, so that lost and repeated tasks leave nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from weftline.llm._common import ROW_KEY, elect, materialise, new_path, with_row_key

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
INPUT = "record_type string, record_id string, target_uri string, refers_to string, payload binary"
_TYPES = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
#: Columns that are headers, and the headers' names.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
MANIFEST = "_manifest"
#: Small files share a partition up to this size; a writer starts a new file beyond it.
GROUP_BYTES = 128 << 20
BATCH_ROWS, BATCH_BYTES, READ_BYTES = 1000, 16 << 20, 1 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(text: str) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(record_type: str, record_id: str, target_uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One record; a revisit names the payload's digest and length but leaves it out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_plain(record_id)}", f"WARC-Date: {EPOCH}"]
    lines += [f"WARC-Target-URI: {_plain(target_uri or '')}"] * (target_uri is not None)
    lines += [f"WARC-Profile: {PROFILE}"] * (record_type == "revisit") + [f"WARC-Refers-To: {_plain(refers_to or '')}"] * bool(refers_to)
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Inflated:
    """Bytes of the gzip members of a file one after the other; reads forward only."""

    def __init__(self, raw):
        self.raw, self.more, self.unit, self.ready, self.begun = raw, b"", zlib.decompressobj(31), bytearray(), False

    def _fill(self, size: int) -> None:
        while len(self.ready) < size:
            if self.unit.eof:
                self.more, self.unit, self.begun = self.unit.unused_data or self.more, zlib.decompressobj(31), False
            data = self.more or self.raw.read(READ_BYTES)
            self.more = b""
            if not data:
                if self.begun and not self.unit.eof:
                    raise EOFError("a gzip member ends before its end")
                return
            self.begun = True
            self.ready += self.unit.decompress(data)

    def read(self, size: int) -> bytes:
        self._fill(size)
        out = bytes(self.ready[:size])
        del self.ready[:size]
        return out

    def skip(self, size: int) -> None:
        while size > 0 and (some := self.read(min(size, READ_BYTES))):
            size -= len(some)

    def readline(self) -> bytes:
        at = 0
        while (end := self.ready.find(b"\n", at)) < 0:
            at, before = len(self.ready), len(self.ready)
            self._fill(before + 1)
            if len(self.ready) == before:
                return self.read(before)
        return self.read(end + 1)


class _Seeking:
    """A plain file, read ahead in parts; unwanted bytes beyond what is read are skipped by seeking."""

    def __init__(self, raw):
        self.raw, self.ready, self.at = raw, b"", 0

    def _fill(self, size: int) -> None:
        parts = [self.ready[self.at :]]
        have = len(parts[0])
        while have < size and (data := self.raw.read(max(READ_BYTES, size - have))):
            parts.append(data)
            have += len(data)
        self.ready, self.at = b"".join(parts), 0

    def read(self, size: int) -> bytes:
        if len(self.ready) - self.at < size:
            self._fill(size)
        out = self.ready[self.at : self.at + size]
        self.at += len(out)
        return out

    def skip(self, size: int) -> None:
        ahead = len(self.ready) - self.at
        if size <= ahead:
            self.at += size
        else:
            self.ready, self.at = b"", 0
            self.raw.seek(size - ahead, 1)

    def readline(self) -> bytes:
        while (end := self.ready.find(b"\n", self.at)) < 0:
            have = len(self.ready) - self.at
            self._fill(have + 1)
            if len(self.ready) == have:
                return self.read(have)
        return self.read(end + 1 - self.at)


def records(stream, wanted, payload: bool = True, verify: bool = False) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers in lower case, payload) of the records whose headers are wanted; None for a payload that isn't asked for or stored."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode(errors="replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        if not wanted(headers):
            stream.skip(size)
            continue
        revisit = headers.get("warc-type") == "revisit"
        if not payload and not verify or revisit:
            stream.skip(size)
            yield headers, None
            continue
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        body = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
        if verify and headers.get("warc-payload-digest") != f"sha1:{digest(body)}":
            raise ValueError(f"record {headers.get('warc-record-id')} doesn't have the payload that its digest names")
        yield headers, body if payload else None


def _row(headers: dict[str, str], body: bytes | None) -> tuple:
    values = {c: headers.get(h) for c, h in HEADERS.items()}
    values["payload_digest"] = (values["payload_digest"] or "").removeprefix("sha1:") or None
    length = headers.get("x-payload-length")
    return (*values.values(), int(length) if length else None if body is None else len(body), body)


@dataclass
class Files(InputPartition):
    """The files of one partition."""

    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    """The files that a task wrote."""

    files: list[tuple[str, int]]


def _manifests(store: fs.FileSystem, root: str) -> list[str]:
    """The lists of files that were committed to a folder, one of each commit."""
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if store.get_file_info(root).type == fs.FileType.Directory else []
    return sorted(x.path for x in found if x.base_name.startswith(MANIFEST))


class WarcReader(DataSourceReader):
    """Reads the files under a path; see WarcSource."""

    def __init__(self, options: dict[str, str]):
        self.path, self.tests = options["path"], []
        self.payload, self.verify = (options.get(k, d).lower() == "true" for k, d in (("payload", "true"), ("verify", "false")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality, membership and prefixes of header columns; the rest stays with Spark."""
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if len(column) == 1 and column[0] in HEADERS and isinstance(f, EqualTo | In | StringStartsWith):
                self.tests.append((column[0], type(f).__name__, tuple(f.value) if isinstance(f.value, list | tuple) else f.value))
            else:
                yield f

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            have = headers.get(HEADERS[column])
            if column == "payload_digest":
                have = (have or "").removeprefix("sha1:") or None
            if have is None or not (have in value if kind == "In" else have.startswith(value) if kind == "StringStartsWith" else have == value):
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        lists = _manifests(store, root)
        if lists:
            files = []
            for path in lists:
                with store.open_input_stream(path) as f:
                    files += [(f"{root}/{n}", s) for n, s in json.loads(f.read())]
        elif store.get_file_info(root).type == fs.FileType.File:
            files = [(root, store.get_file_info(root).size)]
        else:
            files = [(x.path, x.size) for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path)]
        groups: list[Files] = []
        size = GROUP_BYTES
        for path, n in sorted(files):
            if size + n > GROUP_BYTES:
                groups.append(Files([]))
                size = 0
            groups[-1].paths.append(path)
            size += n
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                stream = _Inflated(raw) if path.endswith(".gz") else _Seeking(raw)
                for headers, body in records(stream, self._wanted, self.payload, self.verify):
                    rows.append(_row(headers, body))
                    size += len(body or b"") + 500
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=_TYPES)


class WarcWriter(DataSourceArrowWriter):
    """Writes records(INPUT) as files with one gzip member for each record, or plain ones. Each commit adds its list of files; one that overwrites takes the place of all before."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.gzip, self.overwrite = options["path"], options.get("compression", "gzip") == "gzip", overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        done, out, name, size = [], None, "", 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                raw = record(row["record_type"], row["record_id"], row["target_uri"], row["refers_to"], row["payload"] or b"")
                if self.gzip:
                    unit = zlib.compressobj(3, zlib.DEFLATED, 31)
                    raw = unit.compress(raw) + unit.flush()
                out.write(raw)
                size += len(raw)
                if size >= GROUP_BYTES:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        before = _manifests(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        for path in before:
            with store.open_input_stream(path) as f:
                old = json.loads(f.read())
            store.delete_file(path)
            for name, _ in old:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for name, _ in (x for m in messages if m is not None for x in m.files):
            store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """format("warc"): path; on reading payload (true), verify (false: true checks payloads against their digests); on writing compression (gzip, none)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """The records (INPUT) of pages: of equal payloads of at least `least` bytes all but one are revisits.

    The response is the row with the largest id, the first stored of several; null ids lose to others, and if all are null the
    revisits refer to nothing. Null pages have empty payloads. The payloads move once, by row, whatever the groups' sizes.
    """
    keyed = with_row_key(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")))
    slim = keyed.select(*ROW_KEY, "page_id", F.sha2("payload", 256).alias("equal"), (F.octet_length("payload") >= least).alias("counts"))
    slim = materialise(slim, "payload_digests")
    roles = elect(slim.where("counts"), ["equal"], "page_id").select(*ROW_KEY, "leader", "elected")
    revisits = materialise(roles.where("not elected").select(*ROW_KEY, F.lit(True).alias("again"), _urn(F.col("leader")).alias("refers_to")), "revisits")
    joined = keyed.join(revisits, ROW_KEY, "left")
    kind = F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))
    return joined.select(kind.alias("record_type"), _urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), "refers_to", "payload")


def archive_pages(pages: DataFrame, path: str, compression: str = "gzip", **how) -> None:
    """Writes a WARC record for each row of pages below path."""
    register(pages.sparkSession)
    page_records(pages, **how).write.format("warc").option("path", path).option("compression", compression).mode("append").save()


def read_archive(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records (SCHEMA) of the archives below path."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Archives pages in the shared folder and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads of responses are checked against their digests on the way. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    archive_pages(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, least=least)
    back = read_archive(spark, path, payload=False, verify=True)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
