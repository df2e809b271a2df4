"""WARC archives: pages written as records, whole-file gzip streams made seekable, records read back by an index.

Writing gives archives of one gzip stream each.  Nothing in such a stream can be reached without
inflating all before it, so `normalise` inflates each file once, as a stream, writes every record as
a gzip member of its own and a sidecar index of their places (JSON lines: offset, length, type, ...).
`read_records` then deals the index lines, not the files, to tasks, and each inflates its own members.

Of pages with equal payloads one is a response and the others are revisits that refer to it.  Payloads
meet as SHA-1 and length; only these and ids are grouped, so a payload that very many pages share is
summed up by each task first.  Its keeper comes back to the pages by sending keepers to every task: all
of them where there are MOST_KEEPERS at most, else those of payloads with a MOST_KEEPERS-th of all rows or
more (of which there cannot be more than that), the others by a join.

Files stand in a folder that driver and executors share.  An attempt at a task writes under names of
its own, and only files of the returned table (checkpointed) count, so a lost executor or a task that runs
twice leaves at most files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import checkpoint_dir, cut, small_batches, tidy, with_row

#: Uncompressed bytes after which a writer begins another file; bytes of an archive that one read goes over.
FILE_BYTES, SPAN_BYTES, BLOCK = 64 << 20, 16 << 20, 1 << 20
#: Keepers that are sent to every task at most (some 100 bytes each).
MOST_KEEPERS = 100_000
#: Most bytes of one record's head; a longer one is not a WARC file.
MOST_HEAD = 1 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ARCHIVES = "archive string, records long, bytes long"
NORMAL = "archive string, index string, records long, bytes long, error string"
INDEX = "offset long, length long, type string, id string, uri string, digest string"
RECORDS = "archive string, offset long, type string, record_id string, uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, error string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (bytes), row, sha1, payload_bytes, record_type, refers_to, refers_row of every row of pages.

    A null html is empty.  Of rows with equal payloads of least_bytes or more the one with the largest
    page_id is the response (a null is smaller than all; among rows of one page_id any, but one);
    the others are revisits that refer to it.
    """
    named = with_row(pages, ["page_id", "url", "html"])
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    full = named.select(F.col("page_id").cast("long").alias("page_id"), "url", "row", body.alias("html")).withColumns({"sha1": F.sha1("html"), "payload_bytes": F.octet_length("html").cast("long")})
    narrow = full.where(F.col("payload_bytes") >= least_bytes).select("sha1", "payload_bytes", "page_id", "row")
    groups = narrow.groupBy("sha1", "payload_bytes").agg(F.max(F.struct("page_id", "row")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    keepers = cut(groups.where("n > 1").select(F.col("sha1").alias("of"), F.col("payload_bytes").alias("of_bytes"), "keeper", "n"))
    found = keepers.agg(F.count(F.lit(1)), F.sum("n")).first()
    on = (F.col("sha1") == F.col("of")) & (F.col("payload_bytes") == F.col("of_bytes"))
    if found[0] <= MOST_KEEPERS:
        joined = full.join(F.broadcast(keepers), on, "left")
    else:
        # no more than MOST_KEEPERS payloads can have a MOST_KEEPERS-th of the repeated rows each
        least = found[1] / MOST_KEEPERS
        hot = full.join(F.broadcast(keepers.where(F.col("n") >= least)), on, "left")
        rest = keepers.where(F.col("n") < least).withColumnsRenamed({"of": "of2", "of_bytes": "of_bytes2", "keeper": "keeper2"}).drop("n")
        # a row that has its keeper already gets a key of its own, so that no task holds all of them
        key = F.when(F.col("of").isNull(), F.col("sha1")).otherwise(F.col("row"))
        joined = hot.withColumn("key", key).join(rest, (F.col("key") == F.col("of2")) & (F.col("payload_bytes") == F.col("of_bytes2")), "left").withColumn("keeper", F.coalesce("keeper", "keeper2"))
    again = F.col("keeper").isNotNull() & (F.col("keeper.row") != F.col("row"))
    small_batches(joined)
    return joined.select(
        "page_id", "url", "html", "row", "sha1", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("keeper.page_id")).alias("refers_to"), F.when(again, F.col("keeper.row")).alias("refers_row"),
    )


def record_id(row: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(row.encode()).hexdigest())}>"


def _uri(url: str | None) -> str | None:
    """A URI that can stand in a head: blanks and control characters are percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _head(fields: list[tuple[str, object]]) -> bytes:
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]).encode()


def page_record(page_id, url, row, kind, html: bytes, sha1: str, size: int, refers_to, refers_row, date: str = DATE) -> bytes:
    """One record of a page; a revisit has the head of the response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (html if kind == "response" else b"")
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    again = kind == "revisit"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(row)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE if again else None),
        ("WARC-Refers-To", record_id(refers_row) if again else None), ("WARC-Refers-To-Page-ID", refers_to if again else None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body)),
    ]
    return _head(fields) + body + b"\r\n\r\n"


def _info(name: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    return _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(body))]) + body + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, level: int = 6, file_bytes: int = FILE_BYTES) -> DataFrame:
    """archive, records, bytes of the files written under folder: rows of with_roles as WARC, each file one gzip stream."""

    def run(batches):
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, pack, path, held, records, k = None, None, "", 0, 0, 0

        def closed():
            with out:
                out.write(pack.flush())
                size = out.tell()
            return pa.record_batch([pa.array([f"{folder}/{path}"]), pa.array([records]), pa.array([size])], ["archive", "records", "bytes"])

        for batch in batches:
            for r in zip(*(batch.column(c) for c in ("page_id", "url", "row", "record_type", "html", "sha1", "payload_bytes", "refers_to", "refers_row")), strict=True):
                if out is None:
                    path = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{k:04d}.warc.gz"
                    out, pack, held, records, k = store.open_output_stream(f"{base}/{path}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0, k + 1
                    out.write(pack.compress(_info(path)))
                made = page_record(*(x.as_py() for x in r))
                out.write(pack.compress(made))
                held, records = held + len(made), records + 1
                if held >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return cut(rows.mapInArrow(tidy(run), ARCHIVES))


class Inflated:
    """The bytes of a gzip file (of one or of many members), a block at a time."""

    def __init__(self, source, block: int = BLOCK):
        self.source, self.block, self.held, self.ended = source, block, b"", False
        self.pack, self.begun = zlib.decompressobj(31), False

    def more(self) -> bool:
        """Inflate up to a block more; False at the end of the file.  A stream that stops short raises."""
        raw = self.pack.unconsumed_tail
        while not self.ended:
            if self.pack.eof:
                raw = (self.pack.unused_data or self.source.read(self.block)).lstrip(b"\0")
                if not raw:
                    self.ended = True
                    break
                self.pack = zlib.decompressobj(31)
            elif not raw:
                raw = self.source.read(self.block)
                if not raw and not self.begun:  # an empty file
                    self.ended = True
                    break
                if not raw:
                    raise ValueError("gzip stream stops short")
                self.begun = True
            got = self.pack.decompress(raw, self.block)
            raw = self.pack.unconsumed_tail
            if got:
                self.held += got
                return True
        return False

    def take(self, n: int) -> bytes:
        """Up to n bytes, fewer only where a block ends; empty at the end of the file."""
        if not self.held:
            self.more()
        got, self.held = self.held[:n], self.held[n:]
        return got

    def head(self) -> bytes:
        """A record's head with its empty line; empty at the end of the file.  Line ends before it are skipped."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held or not self.more():
                break
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) > MOST_HEAD or not self.more():
                if not self.held:
                    return b""
                raise ValueError("no head of a record")
        got, self.held = self.held[: end + 4], self.held[end + 4 :]
        return got

    def body(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not (got := self.take(n)):
                raise ValueError("record stops short")
            n -= len(got)
            yield got


def fields_of(head: bytes) -> dict[str, str]:
    """Fields by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, found, v in (x.partition(":") for x in lines[1:]) if found}


def _length(fields: dict[str, str]) -> int:
    if not (n := fields.get("content-length", "")).isdigit():
        raise ValueError("no Content-Length")
    return int(n)


def normalise_stream(source, out, index, level: int = 6) -> tuple[int, str | None]:
    """Records of a gzip stream to members of their own, and lines of the index; (records, what went wrong).

    A block at a time, so memory follows neither file nor record.  What stands before a fault is kept;
    a record that was begun then has no line in the index, and its member is closed as it is.
    """
    records, read, pack = 0, Inflated(source), None
    try:
        while head := read.head():
            fields, at = fields_of(head), out.tell()
            length = _length(fields)
            pack = zlib.compressobj(level, zlib.DEFLATED, 31)
            out.write(pack.compress(head))
            for part in read.body(length):
                out.write(pack.compress(part))
            out.write(pack.compress(b"\r\n\r\n") + pack.flush())
            line = {"offset": at, "length": out.tell() - at, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
            index.write((json.dumps(line) + "\n").encode())
            records, pack = records + 1, None
    except (ValueError, zlib.error) as e:
        if pack is not None:
            out.write(pack.flush())
        return records, str(e)
    return records, None


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """archive, index, records, bytes, error of each archive(archive), written anew under folder with a member for each record.

    One task reads a file (a gzip stream cannot be split), as a stream.  A broken or missing file keeps
    the records before its fault and has an error; no other file suffers.
    """

    def run(batches):
        context, k = TaskContext.get(), 0
        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                name = f"records-{context.partitionId():06d}-{context.taskAttemptId()}-{k:04d}.warc.gz"
                k += 1
                made = f"{base}/{name}"
                with target.open_output_stream(made, compression=None) as out, target.open_output_stream(f"{made}.index.jsonl") as index:
                    try:
                        store, path = fs.FileSystem.from_uri(uri)
                        with store.open_input_stream(path, compression=None) as source:
                            records, error = normalise_stream(source, out, index, level)
                    except OSError as e:
                        records, error = 0, str(e)
                    size = out.tell()
                yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([f"{folder}/{name}.index.jsonl"]), pa.array([records]), pa.array([size]), pa.array([error], pa.string())], ["archive", "index", "records", "bytes", "error"])

    one = archives.select("archive")
    n = max(one.count(), 1)
    return cut(one.repartition(min(n, 100_000), "archive").mapInArrow(tidy(run), NORMAL))


def read_index(normal: DataFrame, folder: str) -> DataFrame:
    """archive, offset, length, type, id, uri, digest of the records of normalised archives, from their sidecars."""
    spark = normal.sparkSession
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.index\.jsonl$", 1)
    lines = spark.read.schema(INDEX).option("pathGlobFilter", "*.index.jsonl").json(folder).select("*", name.alias("name"))
    known = normal.select(F.regexp_extract("archive", r"([^/]+)$", 1).alias("known"), "archive")
    return lines.join(known, F.col("name") == F.col("known")).select("archive", "offset", "length", "type", "id", "uri", "digest")


def _whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def read_member(raw: bytes, keep: bool = False) -> dict:
    """What a record's member says; the payload of a response is counted and hashed anew, and kept if asked for."""
    read = Inflated(pa.BufferReader(raw))
    fields = fields_of(read.head())
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    got = {"type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "page_id": _whole(fields.get("warc-page-id")), "refers_to": _whole(fields.get("warc-refers-to-page-id")), "payload_bytes": None, "payload_digest": stated, "payload": None, "error": None}
    body, head, size, digest, parts = read.body(_length(fields)), b"", 0, hashlib.sha1(), []
    if kind not in ("response", "revisit"):
        return got
    for part in body:
        if head is not None:
            head += part
            if (end := head.find(b"\r\n\r\n")) < 0:
                continue
            told = re.search(rb"(?im)^content-length:\s*(\d+)", head[:end])
            part, head = head[end + 4 :], None
        size += len(part)
        digest.update(part)
        if keep and part:
            parts.append(part)
    if kind == "revisit":
        return got | {"payload_bytes": int(told[1]) if head is None and told else None}
    found = base64.b32encode(digest.digest()).decode()
    wrong = "payload differs from its digest" if stated and stated != found else None
    return got | {"payload_bytes": size, "payload_digest": found, "payload": b"".join(parts) if keep else None, "error": wrong}


def read_records(index: DataFrame, payload: bool = False) -> DataFrame:
    """RECORDS (and payload) of index rows(archive, offset, length): each is found by its offset, no file is read through.

    payload_bytes and payload_digest are measured on responses, and as stated on revisits, whose
    refers_to is the page_id that they name.  A member that cannot be read has an error.
    """
    kinds = [("archive", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string()), *([("payload", pa.binary())] if payload else [])]
    schema = pa.schema(kinds)

    def run(batches):
        now, source, made, held = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                got = {"archive": archive, "offset": offset}
                try:
                    if archive != now:
                        if source is not None:
                            source.close()
                        now, source = None, None
                        store, path = fs.FileSystem.from_uri(archive)
                        source = store.open_input_file(path)
                        now = archive
                    source.seek(offset)
                    got |= read_member(source.read(length), payload)
                except (OSError, ValueError, zlib.error) as e:
                    got["error"] = str(e)
                made.append(got)
                held += 200 + len(got.get("payload") or b"")
                if held > BLOCK:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k, _ in kinds} for r in made], schema)
                    made, held = [], 0
        if source is not None:
            source.close()
        if made:
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k, _ in kinds} for r in made], schema)

    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = index.select("archive", "offset", "length").repartition(n, "archive", F.expr(f"offset div {SPAN_BYTES}")).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(tidy(run), RECORDS + (", payload binary" if payload else ""))


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """The page records of archives of pages(page_id, url, html), written, normalised and read back: RECORDS.

    One row for each row of pages: repeated rows are records of their own, a null page_id stays null, a null
    html is an empty payload, other columns are not looked at.  An empty table gives no rows.
    """
    folder = folder or f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    raw = write_archives(with_roles(pages, least_bytes), f"{folder}/raw", level=1)
    normal = normalise(raw, f"{folder}/normal")
    if not normal.take(1):
        return pages.sparkSession.createDataFrame([], RECORDS)
    wrong = normal.where("error is not null").take(1)
    if wrong:
        raise ValueError(f"an archive was not written whole: {wrong[0]['error']}")
    return read_records(read_index(normal, f"{folder}/normal").where("type in ('response', 'revisit')"))
