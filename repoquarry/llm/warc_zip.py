"""WARC records in ZIP-packaged archives: writer, directory reader, and range reads of single records.

An archive is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`, one gzip member for each
WARC record, and `indexes/index.cdxj`, a line for each record with its place in the data.  The reader never
extracts anything: it reads the end of the file, the central directory (ZIP64 too), the index members, and then only the
byte ranges of the wanted records.  Archives are opened by URI through pyarrow's file systems, on whatever shared
storage holds them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.llm.common import prepare
from repoquarry.plans.storage import working_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 256 << 20
LEAST_REVISIT = 1000
JOIN_GAP, READ_BYTES, PART_BYTES = 64 << 10, 8 << 20, 64 << 20
DATE = "2024-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(record_key, url, payload, digest, refers_to) of every row.

    Of records with equal payloads of at least `least` bytes the one with the largest key is the original; the others
    refer to it.  Rows that repeat the largest key are all originals; a null key is smaller than any other and, alone in
    its group, an original.  Null payloads are empty.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("record_key"), url.cast("string").alias("url"), body.alias("payload"))
    # short payloads get keys that match nothing and spread over the join's tasks
    lone = F.concat(F.lit("~"), F.xxhash64("record_key", "payload").cast("string"))
    rows = rows.withColumn("same", F.when(F.length("payload") >= least, F.sha2("payload", 256)).otherwise(lone))
    last = rows.where(F.length("payload") >= least).groupBy("same").agg(F.max("record_key").alias("last"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(last.where("n > 1").drop("n"), "same", "left")
    refers = F.when(~F.col("last").eqNullSafe(F.col("record_key")), F.col("last"))
    return joined.select("record_key", "url", "payload", F.sha1("payload").alias("digest"), refers.alias("refers_to"))


def _urn(key: int | None) -> str:
    return f"<urn:record:{'' if key is None else key}>"


def record_bytes(key, url: str | None, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One WARC record as a gzip member; a revisit carries the HTTP headers of its payload only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    safe = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(key)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {safe}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Archive:
    """One ZIP file being written: records go straight to the data member, their places to the index."""

    def __init__(self, uri: str):
        self.uri = uri
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, key, url, record: bytes) -> None:
        self.data.write(record)
        self.lines.append(json.dumps({"id": _urn(key), "filename": DATA, "offset": self.at, "length": len(record)}))
        self.at += len(record)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(f"{line}\n" for line in self.lines))
        self.zip.writestr("datapackage.json", json.dumps({"resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines), self.at


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of `with_revisits` into archives below `folder`; the result lists (archive, records, bytes).

    A task writes new archives of at most about `archive_bytes`, under names no other attempt uses.  The list is stored
    before it is returned and is what makes an archive count, so attempts that failed leave nothing but unlisted files.
    """
    prepare(records.sparkSession)
    names = ["archive", "records", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or _Archive(f"{folder}/data/{uuid.uuid4().hex}.zip")
                archive.add(row[0], row[1], record_bytes(*row))
                if archive.at >= archive_bytes:
                    done.append(archive.close())
                    archive = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
        if archive:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in archive.close()], names=names)

    listed = records.mapInArrow(run, "archive string, records bigint, bytes bigint")
    listed.write.parquet(f"{folder}/archives")
    return records.sparkSession.read.parquet(f"{folder}/archives")


def _at(source, offset: int, size: int) -> bytes:
    source.seek(offset)
    return source.read(size)


def _extra64(extra: bytes, size: int, packed: int, offset: int) -> tuple[int, int, int]:
    """The fields that a ZIP64 extra field replaces, in their fixed order."""
    while len(extra) >= 4:
        kind, n = struct.unpack("<HH", extra[:4])
        if kind == 1:
            values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
            size, packed, offset = (next(values) if x == 0xFFFFFFFF else x for x in (size, packed, offset))
            break
        extra = extra[4 + n :]
    return size, packed, offset


def directory(source, length: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, method, packed size, size, first byte of the data) of all members of an open archive.

    Raises ValueError where the file is no readable ZIP archive.
    """
    tail_at = max(0, length - 65_557)
    tail = _at(source, tail_at, length - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack("<H", tail[end + 20 : end + 22])[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    entries, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if (entries == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF) and tail_at + end >= 20:
        locator = _at(source, tail_at + end - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            end64 = _at(source, struct.unpack("<Q", locator[8:16])[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            entries, size, start = struct.unpack("<QQQ", end64[32:56])
    if start + size > length:
        raise ValueError("central directory lies outside the file")
    held, at = _at(source, start, size), 0
    for _ in range(entries):
        if held[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, name_n, extra_n, comment_n, offset = struct.unpack("<10xH8xIIHHH8xI", held[at : at + 46])
        name = held[at + 46 : at + 46 + name_n].decode("utf-8", "replace")
        extra = held[at + 46 + name_n : at + 46 + name_n + extra_n]
        full, packed, offset = _extra64(extra, full, packed, offset)
        local = _at(source, offset, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        yield name, method, packed, full, offset + 30 + sum(struct.unpack("<HH", local[26:30]))
        at += 46 + name_n + extra_n + comment_n


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    source = system.open_input_file(path)
    return source, source.size()


def members(archives: DataFrame, column: str = "archive") -> DataFrame:
    """(archive, name, method, packed, size, data_offset, error) of the members of all archives named in `column`.

    A file that can't be opened or read as ZIP yields one row with `error` and nulls; a null name is left out.
    """
    names = ["archive", "name", "method", "packed", "size", "data_offset", "error"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                found = []
                try:
                    source, length = _open(uri)
                    with source:
                        found = [(uri, *member, None) for member in directory(source, length)]
                except (OSError, ValueError, struct.error) as problem:
                    found = [(uri, None, None, None, None, None, str(problem)[:200])]
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    schema = "archive string, name string, method int, packed bigint, size bigint, data_offset bigint, error string"
    return archives.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).mapInArrow(run, schema)


def index_entries(found: DataFrame) -> DataFrame:
    """(archive, record_id, offset, length): the places in the archive file of all records that stored indexes name.

    `found` is the result of `members`.  One task reads the indexes of an archive, piece by piece, beside the list of its stored
    members, so that no record is joined to anything.  Lines that are no JSON object are skipped, as are records of members
    that aren't stored or don't exist.
    """
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own keeps small rows apart
    stored = found.where("method = 0").select("archive", "name", "data_offset", "size").repartition(tasks, "archive")
    listed = stored.groupBy("archive").agg(F.collect_list(F.struct("name", "data_offset", "size")).alias("stored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, stored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                offsets = {member["name"]: member["data_offset"] for member in stored}
                source, _ = _open(uri)
                with source:
                    for offset, size in [(m["data_offset"], m["size"]) for m in stored if m["name"].startswith("indexes/")]:
                        rest, done = b"", 0
                        while done < size:
                            got = _at(source, offset + done, min(1 << 20, size - done))
                            if not got:
                                break
                            done += len(got)
                            *lines, rest = (rest + got).split(b"\n")
                            yield _entries(uri, lines, offsets)
                        yield _entries(uri, [rest], offsets)

    return listed.mapInArrow(run, "archive string, record_id string, offset bigint, length bigint")


def _entries(uri: str, lines: list[bytes], offsets: dict[str, int]) -> pa.RecordBatch:
    rows = []
    for line in lines:
        try:
            x = json.loads(line[line.index(b"{") :])
            rows.append((uri, str(x["id"]), offsets[str(x["filename"])] + int(x["offset"]), int(x["length"])))
        except (ValueError, KeyError, TypeError):
            continue
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = ["archive", "record_id", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def parse_record(data: bytes) -> dict | None:
    """Fields of one gzipped WARC record, or None if it is broken."""
    try:
        record = zlib.decompress(data, 31)
        head, _, rest = record.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        if not first.startswith("WARC/"):
            return None
        block = rest[: int(fields["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        sizes = [int(line[15:]) for line in http.split(b"\r\n") if line[:15].lower() == b"content-length:"]
        revisit = fields.get("warc-type") == "revisit"
        named = fields.get("warc-payload-digest", "")
        digest = base64.b32decode(named[5:]).hex() if named.startswith("sha1:") else None
        own = None if revisit else hashlib.sha1(payload).hexdigest()
        return {
            "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
            "refers_to": fields.get("warc-refers-to"), "payload": None if revisit else payload, "payload_digest": own or digest,
            "payload_bytes": (sizes or [None])[0] if revisit else len(payload), "intact": revisit or digest in (None, own),
        }
    except (zlib.error, ValueError, KeyError):
        return None


def read_records(entries: DataFrame, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """The records at (archive, offset, length), each read by its range; neighbouring ranges are read together.

    A range that holds no WARC record yields a row of nulls with `intact` false.  The ranges are dealt over `tasks` (default: the
    session's shuffle partitions) by archive and stretch of `PART_BYTES`; their rows are small, what is read is not.
    """
    tasks = tasks or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prepare(entries.sparkSession)
    fields = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_())]
    fields = [f for f in fields if payloads or f[0] != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            records, k = [], 0
            while k < len(rows):
                uri, start, length = rows[k]
                stop, end = k + 1, start + length
                while stop < len(rows) and rows[stop][0] == uri and 0 <= rows[stop][1] - end <= JOIN_GAP and rows[stop][1] + rows[stop][2] - start <= READ_BYTES:
                    end = rows[stop][1] + rows[stop][2]
                    stop += 1
                if uri != opened:
                    if source:
                        source.close()
                    opened, (source, _) = uri, _open(uri)
                held = _at(source, start, end - start)
                records += [parse_record(held[a - start : a - start + n]) or {"intact": False} for _, a, n in rows[k:stop]]
                k = stop
            columns = [pa.array([r.get(name) for r in records], kind) for name, kind in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["archive", "offset", *(f[0] for f in fields)])
        if source:
            source.close()

    split = entries.select("archive", "offset", "length").withColumn("part", F.floor(F.col("offset") / F.lit(PART_BYTES)))
    ordered = split.repartition(tasks, "archive", "part").sortWithinPartitions("archive", "offset").drop("part")
    spark_types = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ordered.mapInArrow(run, "archive string, offset bigint, " + ", ".join(f"{n} {spark_types[t]}" for n, t in fields))


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives on shared storage and read the records back from them."""
    written = write_archives(with_revisits(pages), folder or working_dir(spark, "archives"))
    total = written.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(total // PART_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_records(index_entries(members(written)), payloads=False, tasks=tasks)
