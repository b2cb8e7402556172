"""Operator 9: a deterministic sharded WARC writer with identical-payload revisits.

Pages go into ascending key ranges that follow from the rows alone
(``key_shards``); a shard's task writes its records in key order, rolls to a new
file once the compressed size passes ``roll``, and regenerates every header:
record ids from the key, lengths, and SHA-1 digests of block and payload.  Every
record is a gzip member of its own with no time stamp, so equal rows give equal
bytes.  Files are written under a name of the attempt, renamed to
``shard-...-<digest>.warc.gz``, and named by the manifest of Spark's writer; a
repeated attempt gives the same file again.

Of records with equal payloads (of at least ``least_payload`` bytes) that with the
largest key is the response; the others are revisit records that refer to it.

Record ids are made from the kind, key, address and payload digest, and from an
ordinal where rows repeat all of them, so no two records share one.  Addresses keep
their characters; what a header line cannot hold is percent-encoded.

Null html is an empty payload, null url an empty target (``about:blank``).  Rows without a key
come first and, like rows that repeat the key of a response, are responses
themselves.  Keys may span all 64-bit integers.  Very long pages are one record each; an empty table
writes no file.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import lean
from .ranges import filesystem, key_shards
from .store import new_folder, written

ROLL_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard int, seq int, file string, records long, bytes long"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page-archive")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(kind: str, name: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", len(block))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode()


def target(url: str | None) -> str:
    """The address as a header's value: printable ASCII stays, all else is percent-encoded."""
    return quote(url, safe=_PRINTABLE) if url else "about:blank"


def record(key: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str] | None = None, ordinal: int = 0) -> bytes:
    """The bytes of a response record, or of a revisit record if ``refers_to`` gives the response's key and url.

    ``ordinal`` counts rows with the same key, address and payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url, sha = target(url), digest(payload)
    name = lambda kind, k, u, n=0: f"{kind} {k} {u} {sha}" + (f" {n}" if n else "")
    fields: list[tuple[str, object]] = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    if key is not None:
        fields.append(("Page-Key", key))
    if refers_to is None:
        block = http + payload
        return _header("response", name("response", key, url, ordinal), fields, block) + block + b"\r\n\r\n"
    to, to_url = refers_to[0], target(refers_to[1])
    fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(_NAMES, name('response', to, to_url))}>"), ("WARC-Refers-To-Target-URI", to_url), ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-Key", to)]
    return _header("revisit", name("revisit", key, url, ordinal), fields, http) + http + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    data = b""
    while True:
        if not data and not (data := stream.read(1 << 16)):
            return
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if not data and not (data := stream.read(1 << 16)):
                raise ValueError("cut archive")
            parts.append(one.decompress(data))
            data = one.unused_data
        yield b"".join(parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record; wrong lengths and digests raise."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if first != "WARC/1.1" or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("a block differs from its digest")
    return fields, block


class _Archive:
    def __init__(self, folder: str, shard: int, seq: int) -> None:
        self.fs, self.base = filesystem(folder)
        self.shard, self.seq = shard, seq
        self.temporary = f"{self.base}/.{shard:05d}-{seq:05d}-{uuid.uuid4().hex}"
        self.out, self.sum = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha1()
        self.size = self.records = 0
        block = b"software: caseloom\r\nformat: WARC File Format 1.1\r\n"
        self._write(_header("warcinfo", f"info {shard} {seq}", [("Content-Type", "application/warc-fields")], block) + block + b"\r\n\r\n")

    def _write(self, data: bytes) -> None:
        data = packed(data)
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._write(data)
        self.records += 1

    def commit(self) -> tuple:
        self.out.close()
        name = f"shard-{self.shard:05d}-{self.seq:05d}-{self.sum.hexdigest()[:16]}.warc.gz"
        self.fs.move(self.temporary, f"{self.base}/{name}")
        return self.shard, self.seq, name, self.records, self.size


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_payload: int = 0, roll: int = ROLL_BYTES) -> DataFrame:
    """Write a record for each row; returns the committed manifest."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(url, F.lit("")).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    size = F.octet_length("html")
    sums = written(rows.select("key", "url", size.alias("size"), F.unhex(F.sha1("html")).alias("digest")), "payload-digests")
    shard, n = key_shards(sums, "key", F.col("size"), F.xxhash64("digest"))
    # The html is shuffled once, to its shard; revisit marks join it there by order.
    known = sums.where((F.col("size") >= least_payload) & F.col("key").isNotNull())
    kept = known.groupBy("digest").agg(F.max(F.struct("key", "url")).alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "to")
    marks = known.join(kept, "digest").where("key <> to.key").select("key", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit("").alias("html"), "digest", "to").distinct()
    none = F.lit(None)
    bodies = rows.select("key", F.lit(1).alias("kind"), "url", "html", none.cast("binary").alias("digest"), none.cast(kept.schema["to"].dataType).alias("to"))
    both = shard(marks.unionByName(bodies), F.xxhash64(F.coalesce("digest", F.unhex(F.sha1("html"))))).select("shard", "key", "kind", "url", "html", "digest", F.col("to.key").alias("to_key"), F.col("to.url").alias("to_url"))
    both = both.repartitionByRange(n, "shard").sortWithinPartitions("shard", "key", "kind", "url", "html")

    def run(batches):
        filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
        now, done, of, marked, last, again = None, [], None, {}, None, 0
        for batch in batches:
            for s, k, kind, address, body, dig, to, to_url in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "kind", "url", "html", "digest", "to_key", "to_url")), strict=True):
                if k != of or k is None:
                    of, marked = k, {}
                if kind == 0:
                    marked[dig] = (to, to_url)
                    continue
                payload = body.encode()
                if now is None or now.shard != s or now.size >= roll:
                    if now is not None:
                        done.append(now.commit())
                    now = _Archive(folder, s, now.seq + 1 if now is not None and now.shard == s else 0)
                again = again + 1 if (k, address, body) == last else 0
                last = (k, address, body)
                now.add(record(k, address, payload, marked.get(hashlib.sha1(payload).digest()) if marked else None, again))
        if now is not None:
            done.append(now.commit())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True)) or [[]] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["shard", "seq", "file", "records", "bytes"])

    return written(both.mapInArrow(lean(run), MANIFEST), "archive-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to) of the records in a manifest's files, digests verified."""
    # One task for each file: a number given is not coalesced, however few bytes the manifest has.
    files = manifest.select("file", "shard", "seq").repartitionByRange(max(1, manifest.count()), "shard", "seq").select("file")
    schema = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        fs, base = filesystem(folder)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for fields, block in map(parsed, members(f)):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != found):
                            raise ValueError("a payload differs from its digest")
                        key, to = fields.get("Page-Key"), fields.get("Refers-To-Page-Key")
                        rows.append((None if key is None else int(key), fields["WARC-Target-URI"], size, found, fields["WARC-Type"], None if to is None else int(to)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.mapInArrow(lean(run), schema)


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_payload: int = 0) -> DataFrame:
    """Write the archives of ``pages`` to a new shared folder and read them back."""
    folder = new_folder(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder, key, url, html, least_payload), folder)
