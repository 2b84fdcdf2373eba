"""WARC archives: written as one gzip stream for a file, then normalised to a gzip member for each record.

A gzip stream over a whole archive can only be read from its start. The normaliser inflates such a stream once, cuts it
at the records, writes each record as a gzip member of its own and notes where it begins: an offset index, kept both as
a file beside the archive and as a table. After that any record is read with one seek.

Archives live in a shared folder that pyarrow can write (file, hdfs, s3, gs). A task writes under a name of its own and
returns it; only the names that a committed job returned are read, so a lost task leaves an orphan file, not a wrong one.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import HEAVY_SHARE, ship
from panelloom.sources.storage import materialize, scratch_path

#: Equal payloads below this many bytes are all stored.
LEAST_REVISIT = 100
#: A file is closed after so many bytes of records.
FILE_BYTES = 1 << 30
_CHUNK = 1 << 18
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to (null: store the payload).

    Of pages with equal payloads of at least LEAST_REVISIT bytes, those with the least page_id are stored, the others
    refer to it; where all page ids are null, all are stored. Null html is an empty payload. The table of repeated
    payloads is written first: if it is small, Spark sends it to the pages and no page is shuffled; if not, its heavy
    payloads, at most HEAVY_SHARE, are broadcast and the rest are joined by digest.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    first = (pages.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("payload_digest")
             .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _first IS NOT NULL"))
    first = materialize(first, "repeated-payloads")
    total = first.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    is_heavy = F.col("_n") * HEAVY_SHARE > total
    heavy = first.filter(is_heavy).select("payload_digest", F.col("_first").alias("_heavy"))
    light = first.filter(~is_heavy).select(F.col("payload_digest").alias("_key"), F.col("_first").alias("_light"))
    known = pages.join(F.broadcast(heavy), "payload_digest", "left")
    # pages of a heavy payload need no partner: a key of their own spreads them
    known = known.withColumn("_key", F.when(F.col("_heavy").isNull(), F.col("payload_digest"))
                             .otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    known = known.join(light, "_key", "left").withColumn("_first", F.coalesce("_heavy", "_light"))
    other = F.col("page_id").isNull() | (F.col("page_id") > F.col("_first"))
    return known.select("page_id", "url", "html", "payload_digest", F.when(other, F.col("_first")).alias("refers_to"))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: the payload behind an HTTP header, or for a revisit the header alone."""
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {target} {digest}")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of `classify`'s rows, a single gzip stream each: (file, records). The table is written once."""
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, top = _filesystem(folder)
        rows = (row for batch in batches for k in range(0, batch.num_rows, 64)
                for row in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns)))
        for first in rows:
            path, size, records = f"{top}/whole-{uuid.uuid4().hex}.warc.gz", 0, 0
            with filesystem.open_output_stream(path, compression=None) as out:
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                for page_id, url, html, digest, refers_to in itertools.chain([first], rows):
                    raw = record(page_id, url, html.encode(), digest, refers_to)
                    out.write(packer.compress(raw))
                    size, records = size + len(raw), records + 1
                    if size >= FILE_BYTES:
                        break
                out.write(packer.flush())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["file", "records"])

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    return materialize(pages.mapInArrow(write, "file string, records long"), "warc-files")


class Inflated:
    """Reads through one gzip stream, or several in a row, in pieces; holds one piece and what is asked for."""

    def __init__(self, stream):
        self.stream, self.inflater, self.held, self.ended = stream, zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        while not self.ended:
            packed = self.inflater.unconsumed_tail or self.inflater.unused_data
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            packed = packed or self.stream.read(_CHUNK)
            if not packed:
                self.ended = True
                break
            raw = self.inflater.decompress(packed, _CHUNK)
            if raw:
                self.held += raw
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to and with `mark`; None at the end of the stream."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record header")
                return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark):]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise ValueError("the archive ends inside a record")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            yield part


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").strip().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


INDEX = "file string, offset long, length long, record_id string, record_type string, target string, page_id string"


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives (`file`: any gzip WARC) with a member for each record; returns the offset index as a table.

    One task inflates one file from its start, since a gzip stream has no other entry; files of different size are
    dealt to tasks as they become free. A record passes in pieces, so long ones need no more memory.
    """
    ship(files.sparkSession)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, top = _filesystem(folder)
        for source in (x for batch in batches for x in batch.column(0).to_pylist()):
            path, offset, lines = f"{top}/records-{uuid.uuid4().hex}.warc.gz", 0, []
            with filesystem.open_input_stream(source, compression=None) as stream, \
                    filesystem.open_output_stream(path, compression=None) as out, \
                    filesystem.open_output_stream(path + ".idx", compression=None) as index:
                reader = Inflated(stream)
                while (head := reader.until(b"\r\n\r\n")) is not None:
                    found = headers(head)
                    packer, length = zlib.compressobj(1, zlib.DEFLATED, 31), 0
                    for part in itertools.chain([head.lstrip()], reader.take(int(found["content-length"])), [b"\r\n\r\n"]):
                        packed = packer.compress(part)
                        out.write(packed)
                        length += len(packed)
                    packed = packer.flush()
                    out.write(packed)
                    length += len(packed)
                    b"".join(reader.take(4))
                    line = (path, offset, length, found.get("warc-record-id"), found.get("warc-type"),
                            found.get("warc-target-uri"), found.get("x-page-id"))
                    index.write(f"{offset} {length} {line[3]} {line[4]} {line[5]}\n".encode())
                    lines.append(line)
                    offset += length
                    if len(lines) == 4096:
                        yield _index_batch(lines)
                        lines = []
            if lines:
                yield _index_batch(lines)

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    tasks = max(1, files.count())
    return materialize(files.select("file").repartition(tasks).mapInArrow(rewrite, INDEX), "warc-index")


def _index_batch(lines: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), types)], names)


def read_records(index: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records that `index` names, each read by its offset: page_id, record_type, payload_bytes, payload_digest,
    refers_to and with `keep_payload` the payload (null for a revisit).

    A stored payload is measured, and its digest must be the one in its header; a revisit has both from its headers.
    Rows of one file come in the order of their offsets.
    """
    ship(index.sparkSession)
    schema = "page_id string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    schema += ", payload binary" if keep_payload else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _filesystem(folder)
        path, file = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = []
                for name, offset, length in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    if name != path:
                        if file:
                            file.close()
                        path, file = name, filesystem.open_input_file(name)
                    file.seek(offset)
                    out.append(_parse(zlib.decompress(file.read(length), 31)))
                rows = list(zip(*out))
                columns = [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()),
                           pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())]
                names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
                if keep_payload:
                    columns.append(pa.array(rows[5], pa.binary()))
                    names.append("payload")
                yield pa.RecordBatch.from_arrays(columns, names)
        if file:
            file.close()

    rows = index.select("file", "offset", "length").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(read, schema)


def _parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    found = headers(head)
    block = rest[: int(found["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(headers(http)["content-length"])
    digest = found["warc-payload-digest"].partition(":")[2]
    if found["warc-type"] == "revisit":
        return found.get("x-page-id"), "revisit", size, digest, found.get("x-refers-to-page"), None
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {found.get('warc-record-id')} differs from its header")
    return found.get("x-page-id"), "response", size, digest, None, payload


def roundtrip(pages: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Pages (page_id, url, html) to archives, normalised, and read back by offset; columns as `read_records`.

    Null html is an empty payload, a null url is named after the page, a null page_id stays null, repeated rows are
    records each, other columns are ignored, an empty table gives no archive and no rows.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    files = write_monolithic(classify(pages), f"{folder}/whole")
    index = normalise(files, f"{folder}/records")
    id_type: T.DataType = pages.schema["page_id"].dataType
    found = read_records(index, f"{folder}/records", keep_payload)
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
