"""WARC archives: a writer of one gzip member per record and a sequential
reader with incremental decompression, content-length framing and digests.

The reader takes archives of other writers too: records of any type, ids as
text, digests by any algorithm that hashlib has, in hex or base32, or none.

Archives lie in a folder that all executors share and are opened by URI, so
any store that pyarrow knows will do. A task writes under names of its own
attempt; only the manifest rows of tasks that ended well name archives that
count, so a task that is run again leaves no record twice.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shared_path

MIN_REVISIT_BYTES = 100
#: A new archive is begun after so many bytes of compressed records.
ARCHIVE_BYTES = 64 << 20
_READ = 1 << 16
_DATE = "1970-01-01T00:00:00Z"
_ID = "urn:readloom:page:"
#: Parts of a hot digest in the search for responses.
SALTS = 8


class WarcError(ValueError):
    """A record that is cut off, wrongly framed or fails its digest."""


def record_bytes(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit of refers_to without the payload, as
    one gzip member. The HTTP head gives the full payload's length in both."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in uri or "urn:unknown")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


class _Members:
    """The gzip members of a stream, one after another, decompressed piece by piece."""

    def __init__(self, stream) -> None:
        self.stream, self.rest, self.buffer, self.count, self.inflate = stream, b"", bytearray(), 0, None

    def begin(self) -> bool:
        """Goes to the next member; False at the end of the stream."""
        self.rest = self.rest or self.stream.read(_READ)
        if not self.rest:
            return False
        self.inflate, self.count = zlib.decompressobj(31), self.count + 1
        return True

    def more(self) -> bool:
        """Appends a piece to the buffer; False at the end of the member."""
        while not self.inflate.eof:
            data = self.rest or self.stream.read(_READ)
            self.rest = b""
            if not data:
                raise WarcError("the archive ends within a gzip member")
            try:
                out = self.inflate.decompress(data, _READ * 16)
            except zlib.error as e:
                raise WarcError(f"gzip member {self.count}: {e}") from e
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                self.buffer += out
                return True
        return False

    def upto(self, mark: bytes) -> bytes:
        """What comes before the mark, which is passed over."""
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                raise WarcError(f"gzip member {self.count} ends within a record's head")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise WarcError(f"gzip member {self.count} ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def end(self) -> None:
        if self.buffer or self.more():
            raise WarcError(f"gzip member {self.count} holds more than a record")


def read_digest(field: str) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a labelled digest in hex or base32; None if there
    is none or the algorithm is not known."""
    name, _, value = field.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in hashlib.algorithms_available or not (size := hashlib.new(name).digest_size):
        return None
    try:
        if len(value) == 2 * size:
            return name, bytes.fromhex(value)
        found = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except (ValueError, binascii.Error) as e:
        raise WarcError(f"digest {field!r}: {e}") from e
    if len(found) != size:
        raise WarcError(f"digest {field!r} has a wrong length")
    return name, found


def _dechunked(body: bytes) -> bytes | None:
    """A body in chunked transfer coding without the coding; None if it is not."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return None


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on
    with the field before."""
    out, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"no header field: {line[:40]!r}")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def read_records(stream) -> Iterator[dict]:
    """The records of an archive in order; holds one record at a time.

    Each is one gzip member and is checked: framing, block digest, and the
    payload digest of all that hold their payload, where they have one. A
    failure raises :class:`WarcError`. payload: the body of HTTP records, the
    block of others, None for revisits. payload_digest: bare hex of SHA-256, of
    the payload or as a revisit has it; another algorithm's has its name first.
    payload_bytes of a revisit: the Content-Length of its HTTP head or None.
    """
    source = _Members(stream)
    while source.begin():
        version, *lines = source.upto(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError(f"no WARC version line: {version[:40]!r}")
        fields = _fields(lines)
        if not fields.get("content-length", "").isdecimal():
            raise WarcError("a record without Content-Length")
        block = source.take(int(fields["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise WarcError("a record does not end where Content-Length says")
        source.end()
        kind, name, http = fields.get("warc-type", ""), fields.get("warc-record-id", "").strip("<>"), {}
        said = read_digest(fields.get("warc-block-digest", ""))
        if said and hashlib.new(said[0], block).digest() != said[1]:
            raise WarcError(f"block digest of {name}")
        payload, told = block, read_digest(fields.get("warc-payload-digest", ""))
        if fields.get("content-type", "").partition(";")[0].strip().lower() == "application/http":
            head, _, payload = block.partition(b"\r\n\r\n")
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        if kind == "revisit":
            length = http.get(b"content-length", b"")
            size, payload = int(length) if length.isdigit() else None, None
            digest = None if told is None else told[1].hex() if told[0] == "sha256" else f"{told[0]}:{told[1].hex()}"
        else:
            if told and hashlib.new(told[0], payload).digest() != told[1]:
                plain = _dechunked(payload) if b"chunked" in http.get(b"transfer-encoding", b"").lower() else None
                if plain is None or hashlib.new(told[0], plain).digest() != told[1]:
                    raise WarcError(f"payload digest of {name}")
                payload = plain
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        yield {
            "record_id": name, "url": fields.get("warc-target-uri", "").strip("<>") or None, "payload": payload, "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        }


def with_revisits(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds _payload, _digest, _refers, the smallest id of the records with the
    same payload where this one is not it, and _named, whether this record is
    the one that others refer to. Digests are grouped in two steps, and joined
    under some salts, so that a payload that a third of all rows share is in no
    single task."""
    rows = pages.withColumn("_payload", F.coalesce(F.col(body_col), F.lit("")).cast("binary")).withColumn("_digest", F.sha2("_payload", 256))
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    light = pages.select(F.col(id_col).alias("_i"), body.alias("_b")).where((F.octet_length("_b") >= min_bytes) & F.col("_i").isNotNull())
    ids = light.groupBy(F.sha2("_b", 256).alias("_d"), "_i").agg(F.count("*").alias("_n"))
    first = ids.groupBy("_d").agg(F.min(F.struct("_i", "_n")).alias("_f"), F.sum("_n").alias("_all")).where("_all > 1")
    first = first.select("_d", F.col("_f._i").alias("_first"), (F.col("_f._n") == 1).alias("_lone"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(SALTS)).cast("int")
    joined = rows.withColumn("_s", salt).join(first, (F.col("_digest") == F.col("_d")) & (F.col("_s") == F.col("_salt")), "left")
    named = F.coalesce(F.col("_lone") & (F.col("_first") == F.col(id_col)), F.lit(False))
    return joined.withColumn("_refers", F.when(F.col("_first") < F.col(id_col), F.col("_first"))).withColumn("_named", named)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes a record for each row of pages, and returns the manifest
    (path, records, bytes) of the archives, which is stored as well."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        mine, out, done, n, size = uuid.uuid4().hex, None, [], 0, 0
        try:
            for batch in batches:
                for rid, uri, body, digest, refers, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = f"{_ID}{'' if rid is None else rid}:{digest if named else uuid.uuid4()}"
                    if out is None:
                        name, n, size = f"{mine}-{len(done):05d}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    size += out.write(data := record_bytes(own, uri, body, digest, None if refers is None else f"{_ID}{refers}:{digest}")) or len(data)
                    n += 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                        done.append((f"{folder}/{name}", n, size))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_pylist([{"path": p, "records": n, "bytes": s} for p, n, s in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    rows = with_revisits(pages, id_col, body_col).select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), "_payload", "_digest", F.col("_refers").cast("long"), "_named")
    return Scratch(pages.sparkSession).cut(rows.mapInArrow(run, "path string, records bigint, bytes bigint"))


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in manifest.path, an archive per task:
    record_id, url, payload_bytes, payload_digest, record_type, refers_to (a
    record id), and payload (null for revisits)."""
    schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
    schema = schema.append(pa.field("payload", pa.binary())) if payloads else schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append([r[k] for k in schema.names])
                        size += len(r["payload"] or b"") if payloads else 0
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    kind = "record_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files, "path").mapInArrow(run, kind)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", payloads: bool = False) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back.

    A null body is an empty payload. Rows that repeat the smallest id of a
    payload are responses, as are rows with a null id; a null URL is written
    as ``urn:unknown``. Record ids are unique; where several rows repeat the
    smallest id, a revisit refers to what their ids begin with. An empty table
    gives no archive and an empty result; other columns, whatever their names,
    are not written.
    """
    folder = shared_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    manifest = write_archives(pages.select(id_col, url_col, body_col), folder, id_col, url_col, body_col)
    page = lambda c: F.try_to_number(F.nullif(F.regexp_extract(c, f"^{_ID}(-?[0-9]*):", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")
    found = read_archives(manifest, payloads)
    rest = [c for c in found.columns if c not in ("record_id", "refers_to")]
    return found.select(page("record_id").alias(id_col), *rest, page("refers_to").alias("refers_to"))


#: DuckDB SQL of op6.
WARC_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, d AS payload_digest, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND f < page_id THEN f END AS refers_to
FROM q
"""
