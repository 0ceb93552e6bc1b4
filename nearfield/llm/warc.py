"""WARC archives: a distributed writer and a sequential reader.

Writing. Each page becomes a ``response`` record or, where another page has the
same payload, a ``revisit`` record that names the page it repeats: of equal
payloads the row with the largest id is the response. Which rows are equal is
settled on ids and digests alone, so a payload that a third of all rows share is
never gathered. Every record is one gzip member. A task writes its records to
files of its own, a new one whenever ``file_bytes`` are reached, under names
that no other attempt uses; only the files that finished tasks report go into
the list that the reader takes, so a task that is lost and run again leaves no
record twice.

Reading. A task reads its files from front to back and holds one chunk, one
record head and, if asked for, one payload at a time: members are decompressed
incrementally, the record's head gives the length of its block, block and
payload are digested as they pass, and each must end where the lengths say. A
member that ends early, holds more than its record or has a malformed head, and
in strict reading a digest that differs, raise ``ValueError`` with file and
offset.

A null payload counts as empty, very long ones are streamed. Null ids rank
lowest. Of rows that repeat the response's id and payload, one is the response
and the others revisit it. An empty table gives an empty list of files and no
record. Null urls give a record without a target; what could break a header
line is percent-encoded. Other columns are ignored.

Files are opened with ``pyarrow.fs`` inside the tasks, in a folder that all
executors share (a mounted path, or a store that ``pyarrow`` knows).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.common import cut, slices

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
GZIP = 16 + zlib.MAX_WBITS
END = b"\r\n\r\n"

CHUNK = 64 << 10
MAX_HEAD = 1 << 20  # a longer head, of a record or of the HTTP message in it, is taken as malformed
URN = "urn:x-page:"


def store(uri: str):
    """File system and path of a folder or file named by path or uri."""
    if re.match(r"file:/(?!/)", uri):
        uri = uri[len("file:"):]
    return arrow_fs.FileSystem.from_uri(uri) if "://" in uri else (arrow_fs.LocalFileSystem(), uri)


def bare_digest(data_hash) -> str:
    return base64.b32encode(data_hash.digest()).decode()


# ------------------------------------------------------------------ writing
def plan_records(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``id, url, payload, kind, refers_to, turn`` per row: which record it becomes. Payloads under
    ``min_revisit_bytes`` are all responses."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(bytearray()))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    # an id as two columns that are never null, so that join and window share their partitioning
    same = [F.coalesce(F.col("id").cast("string"), F.lit("")).alias("page"), F.col("id").isNull().alias("none"), F.unhex(F.sha2("payload", 256)).alias("key")]
    by = ["page", "none", "key"]
    keys = cut(own.select("id", *same, F.octet_length("payload").alias("size")).groupBy(*by, "id", "size").agg(F.count(F.lit(1)).alias("rows")))
    # written, so that the join reads plain shuffles and a very common payload's ids can be split over tasks
    groups = cut(
        keys.where(F.col("size") >= min_revisit_bytes).groupBy("key").agg(F.max("id").alias("top"), F.sum("rows").alias("n")).where("n > 1").drop("n")
    )
    shared = keys.join(groups, "key").select(*by, "top", F.lit(True).alias("shared"))
    met = own.select("*", *same).join(shared, by, "left")
    # payloads move once, for the join
    met = met.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0))))
    revisit = F.col("shared").isNotNull() & ~(F.col("id").eqNullSafe(F.col("top")) & (F.col("turn") == 1))
    return met.select(
        "id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("top")).alias("refers_to"), "turn"
    )


def record_id(page, digest: str, turn: int) -> str:
    """A page's record: its id (after ``=``, so that null is told from empty), its payload and which of equal rows it is."""
    return f"{URN}{'' if page is None else '=' + quote(str(page), safe='')}:{digest}:{turn}"


def page_of(record_id_col):
    """Column: the page id, as text, within a record id."""
    return F.url_decode(F.regexp_extract(record_id_col, URN + "(?:=([^:]*))", 1))


def member(headers: list[tuple[str, str]], block: list[bytes], level: int = 6) -> bytes:
    """One record as one gzip member; ``block`` in pieces."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {sum(map(len, block))}\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return b"".join([pack.compress(f"{VERSION}\r\n{head}".encode()), *map(pack.compress, block), pack.compress(END), pack.flush()])


def page_record(page, url, payload: bytes, kind: str, refers_to, turn: int, date: str) -> bytes:
    digest = bare_digest(hashlib.sha1(payload))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = [http, payload] if kind == "response" else [http]
    digested = hashlib.sha1()
    for piece in block:
        digested.update(piece)
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(page, digest, turn)}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if kind == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to, digest, 1)}>")]
    headers += [("Content-Type", HTTP_TYPE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{bare_digest(digested)}")]
    return member(headers, block)


def write_archives(records: DataFrame, folder: str, file_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write what ``plan_records`` returns below ``folder``; the list of files, ``file, records, bytes``, is
    written to ``folder/files`` and returned. ``date`` is the records' capture time."""
    folder = folder.rstrip("/")
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def kernel(batches):
        files, base = store(folder)
        out = None

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((name, count, size), schema)], schema=schema)

        for batch in batches:
            for cols in slices(batch, 64, ["id", "url", "payload", "kind", "refers_to", "turn"]):
                for row in zip(*cols):
                    if out is None:
                        files.create_dir(f"{base}/archives", recursive=True)
                        name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(f"{base}/archives/{name}", compression=None)
                        about = b"format: WARC File Format 1.1\r\n"
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                                ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                        out.write(member(info, [about]))
                    done = page_record(*row, date)
                    out.write(done)
                    count, size = count + 1, size + len(done)
                    if size >= file_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    listed = records.select("id", "url", "payload", "kind", "refers_to", "turn").mapInArrow(kernel, "file string, records bigint, bytes bigint")
    listed.write.parquet(f"{folder}/files")
    return records.sparkSession.read.schema("file string, records bigint, bytes bigint").parquet(f"{folder}/files")


# ------------------------------------------------------------------ reading
def read_headers(text: bytes) -> dict[str, str]:
    """Header lines by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for line in text.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:80]!r}")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def same_digest(declared: str | None, hashes: dict) -> bool | None:
    """Whether the declared digest (algorithm, colon, base32 or hex) holds; None where it can't be told."""
    algorithm, _, value = (declared or "").partition(":")
    made = hashes.get(algorithm.lower())
    if made is None:
        return None
    return value.upper().rstrip("=") == bare_digest(made).rstrip("=") or value.lower() == made.hexdigest()


class Record:
    """One record, fed with the decompressed bytes of its member as they come."""

    def __init__(self, keep_payload: bool):
        self.keep, self.head, self.headers, self.left, self.tail = keep_payload, b"", None, 0, b""
        self.http, self.http_headers, self.payload, self.size = None, {}, [], 0

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            at = self.head.find(END)
            if at < 0:
                if len(self.head) > MAX_HEAD:
                    raise ValueError("record head without an end")
                return
            first, _, rest = self.head[:at].partition(b"\r\n")
            if not first.startswith(b"WARC/"):
                raise ValueError(f"record starts with {first[:40]!r}")
            self.headers, data = read_headers(rest), self.head[at + len(END):]
            length = self.headers.get("content-length", "")
            if not re.fullmatch("[0-9]+", length):
                raise ValueError(f"content length {length[:40]!r}")
            self.left = int(length)
            declared = [self.headers.get(h, "").partition(":")[0].lower() for h in ("warc-block-digest", "warc-payload-digest")]
            algorithms = {"sha1", *(a for a in declared if a in ("sha256", "sha512", "md5"))}
            self.block, self.body = ({a: hashlib.new(a) for a in algorithms} for _ in range(2))
            self.http = b"" if self.headers.get("content-type", "").lower().startswith("application/http") else None
        piece, rest = data[: self.left], data[self.left:]
        self.left -= len(piece)
        for h in self.block.values():
            h.update(piece)
        if self.http is not None:  # still inside the block's own head
            self.http += piece
            at = self.http.find(END)
            if at >= 0:
                self.http_headers = read_headers(self.http[:at].partition(b"\r\n")[2]) if b"\r\n" in self.http[:at] else {}
                piece, self.http = self.http[at + len(END):], None
            elif len(self.http) > MAX_HEAD:
                raise ValueError("HTTP head without an end")
            else:
                piece = b""
        for h in self.body.values():
            h.update(piece)
        self.size += len(piece)
        if self.keep and piece:
            self.payload.append(piece)
        self.tail += rest
        if len(self.tail) > len(END):
            raise ValueError("more data than the content length says")

    def end(self) -> None:
        if self.headers is None or self.left or self.tail != END:
            raise ValueError("the record ends before its content length")

    def row(self) -> tuple:
        h = self.headers
        kind, declared = h.get("warc-type"), h.get("warc-payload-digest")
        bare = lambda name: h[name].strip("<>") if name in h else None
        block_ok = same_digest(h.get("warc-block-digest"), self.block)
        if kind == "revisit":  # the payload is elsewhere; its length is that of the repeated head
            length = self.http_headers.get("content-length", "")
            size = int(length) if re.fullmatch("[0-9]+", length) else None
            digest, payload_ok, payload = declared and declared.partition(":")[2], None, None
        else:
            size, digest = self.size, bare_digest(self.body["sha1"])
            payload_ok = same_digest(declared, self.body)
            payload = b"".join(self.payload) if self.keep else None
        return bare("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), bare("warc-refers-to"), digest, size, block_ok, payload_ok, payload


def read_members(stream, keep_payload: bool = False, chunk: int = CHUNK):
    """``(offset, row)`` of each record of an open archive, front to back."""
    raw, offset = stream.read(chunk), 0
    while raw:
        unpack, record, used = zlib.decompressobj(GZIP), Record(keep_payload), 0
        try:
            while not unpack.eof:
                if not raw:
                    raw = stream.read(chunk)
                    if not raw:
                        raise ValueError("the archive ends inside a record")
                data = unpack.decompress(raw, chunk)
                left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                used, raw = used + len(raw) - len(left), left
                record.feed(data)
            record.end()
            yield offset, record.row()
        except (ValueError, zlib.error) as e:
            raise ValueError(f"at byte {offset}: {e}") from e
        offset += used
        raw = raw or stream.read(chunk)


ROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
    ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block_ok", pa.bool_()),
    ("payload_ok", pa.bool_()), ("payload", pa.binary()),
])


def read_archives(files: DataFrame, folder: str, payloads: bool = False, strict: bool = True) -> DataFrame:
    """One row per record of the archives named in ``files`` (column ``file``, names below ``folder/archives``
    or whole paths). ``payload_digest`` is the bare base32 SHA-1 of what was read (declared by revisits);
    ``payloads`` carries the payloads; ``strict`` raises where a declared digest doesn't hold."""
    folder = folder.rstrip("/")

    def kernel(batches):
        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files_, path = store(name if "/" in name else f"{folder}/archives/{name}")
                with files_.open_input_stream(path, compression=None) as stream:
                    try:
                        for offset, row in read_members(stream, payloads):
                            if strict and False in row[7:9]:
                                raise ValueError(f"at byte {offset}: a digest differs")
                            rows.append((name, offset, *row))
                            held += 500 + (len(row[9]) if row[9] else 0)
                            if held > 4 << 20:
                                yield _rows(rows)
                                rows, held = [], 0
                    except ValueError as e:
                        raise ValueError(f"{path} {e}") from None
        if rows:
            yield _rows(rows)

    # one archive is read by one task; the list is dealt evenly, whatever files it came in
    n = max(1, files.count())
    spread = files.select("file").repartition(min(n, 20_000), "file")
    kinds = ("file string, offset bigint, record_id string, record_type string, target_uri string, date string, refers_to string, "
             "payload_digest string, payload_bytes bigint, block_ok boolean, payload_ok boolean, payload binary")
    return spread.mapInArrow(kernel, kinds)


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROW)], schema=ROW)


def archive_and_read(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, file_bytes: int = 256 << 20, id_col: str = "page_id", **columns) -> DataFrame:
    """``pages`` written as archives below ``folder`` and read back: id, ``payload_bytes, payload_digest,
    record_type, refers_to`` (an id)."""
    kind = pages.schema[id_col].dataType.simpleString()
    files = write_archives(plan_records(pages, min_revisit_bytes, id_col, **columns), folder, file_bytes)
    read = read_archives(files, folder).where("record_type in ('response', 'revisit')")
    page = lambda c: F.when(F.col(c).startswith(URN + "="), page_of(F.col(c))).cast(kind)
    return read.select(page("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
