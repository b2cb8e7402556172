"""Operator 4: token ids as length-delimited binary records with an offset index.

A file holds records back to back:

    u64  length of the payload
    u32  masked CRC-32 of these 8 bytes
    payload: i64 key, then the ids (u16 if all ids of the vocabulary fit, else u32)
    u32  masked CRC-32 of the payload

all little-endian; the mask rotates a checksum right by 15 bits and adds
0xa282ead8, so that checksums over data that holds checksums stay sound.  Beside
each file lies an index of (i64 key, u64 offset, u64 number of ids) entries for
reads in any order.  Files cover ascending key ranges.

A task writes to a name of its own and then renames it; the manifest, itself
committed by Spark's writer, names the files of the attempts that counted.  An
executor that is lost leaves at most files that no manifest names.

Ids are those of an untouched ``Tokenizer.from_file``: the strings of added tokens in
a text become their ids, as the library has it; such texts go to it whole.

Null and empty texts hold the end id only; rows without a key come first.  Keys
may span all 64-bit integers, but the least stands for null.  Rows that repeat a key are all
written, in any order among themselves.  An empty table writes no file.  Very long texts make one record
each.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import windows
from .flat import lean
from .ranges import filesystem, key_shards
from .store import new_folder, written

ROLL_BYTES = 256 << 20
MANIFEST = "shard int, seq int, file string, records long, ids long, bytes long"
#: Stands for a null key, and so sorts first.
NO_KEY = -(1 << 63)
INDEX = struct.Struct("<qQQ")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframed(stream) -> Iterator[bytes]:
    """The payloads of a file; a checksum that differs or a cut record raises."""
    while head := stream.read(12):
        length, check = struct.unpack("<QI", head)
        if check != masked(head[:8]):
            raise ValueError("damaged record length")
        payload, tail = stream.read(length), stream.read(4)
        if len(payload) != length or struct.unpack("<I", tail)[0] != masked(payload):
            raise ValueError("damaged record")
        yield payload


class Encoder:
    """Ids of whole texts by a tokenizer file of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        #: Texts with one of these are left to the library.
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        pre = spec.get("pre_tokenizer") or {}
        #: Matches of the byte-level pattern are encoded one by one, so each distinct one needs the library once only.
        self.by_word = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        letters = np.arange(256, dtype=np.uint32)
        plain = np.zeros(256, bool)
        plain[[*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]] = True
        letters[~plain] = 256 + np.arange(int((~plain).sum()))
        self.letters = letters

    def replay(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, one, ends = self.letters[data].tobytes().decode("utf-32-le"), self.tokenizer.model.tokenize, np.cumsum(lens)
        ids = [[t.id for t in one(text[a:b])] for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
        return np.array([x for w in ids for x in w], np.int32), np.array([len(w) for w in ids], np.int64)

    def encode(self, batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(rows, ids laid end to end, ids of each row)."""
        if self.by_word:
            for part, ids, counts in windows(batches, text, self.replay):
                yield part, *self._with_added(part.column(text), ids, counts)
            return
        from .flat import chunks

        for part in chunks(batches, text):
            got = [e.ids for e in self.tokenizer.encode_batch([x or "" for x in part.column(text).to_pylist()], add_special_tokens=False)]
            yield part, np.array([x for w in got for x in w], np.int32), np.array([len(w) for w in got], np.int64)


    def _with_added(self, texts, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with those of texts that hold an added token replaced by the library's."""
        has = np.zeros(len(counts), bool)
        for token in self.added:
            has |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if not has.any():
            return ids, counts
        ends, parts, counts, at = np.cumsum(counts), [], counts.copy(), 0
        for i in np.flatnonzero(has).tolist():
            own = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, ids.dtype)
            parts += [ids[at : ends[i] - counts[i]], own]
            at, counts[i] = ends[i], len(own)
        return np.concatenate([*parts, ids[at:]]), counts


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _File:
    def __init__(self, folder: str, shard: int, seq: int) -> None:
        self.fs, base = filesystem(folder)
        self.shard, self.seq = shard, seq
        self.temporary = f"{base}/.{shard:05d}-{seq:05d}-{uuid.uuid4().hex}"
        self.out, self.index = self.fs.open_output_stream(self.temporary), []
        self.size = self.ids = 0

    def add(self, key: int, ids: np.ndarray) -> None:
        record = framed(struct.pack("<q", key) + ids.tobytes())
        self.out.write(record)
        self.index.append(INDEX.pack(key, self.size, len(ids)))
        self.size += len(record)
        self.ids += len(ids)

    def commit(self) -> tuple:
        self.out.close()
        name = self.temporary.replace("/.", "/records-") + ".bin"
        with self.fs.open_output_stream(self.temporary + ".x") as f:
            f.write(b"".join(self.index))
        self.fs.move(self.temporary + ".x", name + ".index")
        self.fs.move(self.temporary, name)
        return self.shard, self.seq, name.rpartition("/")[2], len(self.index), self.ids, self.size


def write_records(df: DataFrame, folder: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int | None = 0, roll: int = ROLL_BYTES) -> DataFrame:
    """Write the ids of each whole text, in ascending key order; returns the committed manifest."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    shard, n = key_shards(rows, "key", F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text"))
    rows = shard(rows).withColumn("key", F.coalesce("key", F.lit(NO_KEY))).repartitionByRange(n, "shard").sortWithinPartitions("shard", "key")

    def run(batches):
        filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
        enc, now, done = encoder(tokenizer), None, []
        kind = "<u4" if enc.wide else "<u2"
        for part, ids, counts in enc.encode(batches, "text"):
            ends = np.cumsum(counts).tolist()
            ids, begin = ids.astype(kind), 0
            for k, s, end in zip(part.column("key").to_pylist(), part.column("shard").to_pylist(), ends, strict=True):
                if now is None or now.shard != s or now.size >= roll:
                    if now is not None:
                        done.append(now.commit())
                    now = _File(folder, s, now.seq + 1 if now is not None and now.shard == s else 0)
                one = ids[begin:end]
                now.add(k, one if end_id is None else np.append(one, np.array([end_id], kind)))
                begin = end
        if now is not None:
            done.append(now.commit())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True)) or [[]] * 6, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "seq", "file", "records", "ids", "bytes"])

    return written(rows.mapInArrow(lean(run), MANIFEST), "record-manifest")


def read_records(manifest: DataFrame, folder: str, wide: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) from the files of a manifest, each record verified.

    ``start`` counts the ids of all records before it.  The running sum over
    files is the only ordered step; it has one row for each file.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", before.alias("base"), "shard", "seq")
    files = files.repartitionByRange(max(1, manifest.count()), "shard", "seq").select("file", "base")  # one task for each file

    def run(batches):
        fs, base = filesystem(folder)
        step = 4 if wide else 2
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with fs.open_input_stream(f"{base}/{name}", buffer_size=1 << 20) as f:
                    for payload in unframed(f):
                        ids = np.frombuffer(payload, "<u4" if wide else "<u2", offset=8)
                        rows.append((struct.unpack_from("<q", payload)[0], start, (len(payload) - 8) // step, zlib.crc32(ids.astype("<u4"))))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["key", "start", "n_tokens", "ids_crc32"])

    out = files.mapInArrow(lean(run), "key long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("key", F.nullif("key", F.lit(NO_KEY)))


def read_one(folder: str, file: str, place: int, wide: bool = False) -> tuple[int, np.ndarray]:
    """(key, ids) of the record at ``place`` of a file, found through its index alone."""
    fs, base = filesystem(folder)
    with fs.open_input_file(f"{base}/{file}.index") as f:
        f.seek(place * INDEX.size)
        key, offset, _ = INDEX.unpack(f.read(INDEX.size))
    with fs.open_input_file(f"{base}/{file}") as f:
        f.seek(offset)
        payload = next(unframed(f))
    return key, np.frombuffer(payload, "<u4" if wide else "<u2", offset=8)


def token_records(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int | None = 0) -> DataFrame:
    """Write the records of ``df`` to a new shared folder and read them back."""
    folder = new_folder(df.sparkSession, "token-records")
    manifest = write_records(df, folder, tokenizer, text, key, end_id)
    return read_records(manifest, folder, encoder(tokenizer).wide)
