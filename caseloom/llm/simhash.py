"""Operator 10: SimHash near-duplicates, linked through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments only.  Of two fingerprints that
differ in at most three bits, one segment differs in at most one: it is equal,
or equal once that bit is a wildcard.  Indexing the one-wildcard variants of
the distinct segment values finds the pairs of neighbouring values by an
equality grouping (a variant has at most two values, so no group is hot).  The
members of such pairs are then verified by the distance of whole fingerprints.

Copies collapse to one fingerprint first.  Values with many members are dealt
in blocks over tasks, and a task returns a spanning forest of its links rather
than the links, so that neither memory nor rows follow the square of a group.

Texts: A-Z lower-cased, words split at ASCII white space, shingles of three
words (fewer words: the whole sequence).  Null and empty texts have fingerprint
zero and are linked like any other.  Very long texts are read whole.  Rows that repeat a
key are one document, whose rows keep their own fingerprints; a group without any key has
none as its name.  An empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .flat import LOWER, chunks, flat, gather, lean, spans
from .store import written

DISTANCE = 3
BLOCK = 1024


def _fingerprints(buf: np.ndarray, offs: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """The fingerprint (unsigned) of each row of a flat buffer."""
    starts, ends, first = spans(buf, offs)
    out = np.zeros(len(offs) - 1, np.uint64)
    if not len(starts):
        return out
    lens = ends - starts
    # All words with one space after each; a shingle is then a slice.
    at = np.cumsum(lens + 1) - (lens + 1)
    joined = np.full(int(at[-1] + lens[-1] + 1), 0x20, np.uint8)
    joined[gather(at, lens)] = LOWER[buf[gather(starts, lens)]]
    words = np.diff(first)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    head = gather(first[:-1], count)
    tail = head + np.repeat(np.minimum(words, shingle), count) - 1
    data, one = joined.tobytes(), xxhash.xxh64_digest
    digest = b"".join([one(data[a:b], seed) for a, b in zip(at[head].tolist(), (at[tail] + lens[tail]).tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(digest, np.uint8).reshape(-1, 8), axis=1)
    some = np.flatnonzero(count)
    row_start = (np.cumsum(count) - count)[some]
    ones = np.add.reduceat(bits, row_start, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * ones > count[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp): the fingerprint of each whole text as a signed 64-bit integer."""
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType())])

    def run(batches):
        for part in chunks(batches, text, 1 << 20):
            fp = _fingerprints(*flat(part.column(text)), shingle, seed)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return df.select(key, text).mapInArrow(lean(run), schema)


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``fps`` (uint64)."""
    out, rest = [], fps
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= distance
            if near.any():
                got = rest[near]
                out.extend((int(root), int(x)) for x in got.view(np.int64))
                queue.extend(got)
                rest = rest[~near]
    return [(int(np.uint64(a).view(np.int64)), b) for a, b in out]


def links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(u, v) over distinct fingerprints ``fp``: enough links of distance <= 3 to connect what the links connect."""
    if distance > 3:
        raise ValueError("two segments with one wildcard bit cover distances up to 3")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    # seg: 33 bits, the segment's number and its value.
    member = distinct.select("fp", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("seg"))
    count = member.groupBy("seg").agg(F.count(F.lit(1)).alias("n"))
    bit = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("p")
    variant = count.select("seg", bit).select(F.expr("seg & ~shiftleft(1L, p) | shiftleft(cast(p AS BIGINT), 33)").alias("key"))
    pair = variant.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    pair = pair.select(F.col("key").bitwiseAND(F.lit((1 << 33) - 1)).alias("a"), F.shiftrightunsigned("key", 33).cast("int").alias("p"))
    pair = pair.select("a", F.expr("a | shiftleft(1L, p)").alias("b"))
    pair = written(pair.union(count.where("n > 1").select(F.col("seg").alias("a"), F.col("seg").alias("b"))), "segment-pairs")

    # The members of the values in pairs, dealt in blocks of about `block`.
    used = pair.select(F.explode(F.array("a", "b")).alias("seg")).distinct().join(count, "seg").select("seg", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    used = written(used, "segments")
    dealt = member.join(used, "seg").select("seg", F.pmod(F.xxhash64("fp", "seg"), F.col("blocks")).cast("int").alias("k"), "fp")
    sides = pair.join(used.select(F.col("seg").alias("a"), F.col("blocks").alias("na")), "a").join(used.select(F.col("seg").alias("b"), F.col("blocks").alias("nb")), "b")
    sides = sides.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    sides = sides.where("a < b OR i <= j").select(F.explode(F.expr("CASE WHEN a = b AND i = j THEN array(struct(a AS seg, i AS k)) ELSE array(struct(a AS seg, i AS k), struct(b AS seg, j AS k)) END")).alias("s"), F.struct("a", "b", "i", "j").alias("task"))
    rows = dealt.join(sides.select("s.seg", "s.k", "task"), ["seg", "k"]).select("task", "fp")

    def run(batches):
        held: list[np.ndarray] = []
        now = None

        def done():
            fps = np.concatenate(held) if len(held) > 1 else held[0]
            return _forest(fps, distance) if len(fps) > 1 else []

        out: list[tuple[int, int]] = []
        for batch in batches:
            task = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "i", "j")], axis=1)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            edge = [0, *(np.flatnonzero((task[1:] != task[:-1]).any(axis=1)) + 1).tolist(), len(fp)]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if s == e:
                    continue
                at = tuple(task[s].tolist())
                if at != now:
                    if held:
                        out += done()
                    held, now = [], at
                held.append(fp[s:e])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])
            out = []
        if held:
            out = done()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

    return rows.select("task.*", "fp").repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j").mapInArrow(lean(run), "u long, v long")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component_id): the least key that links of at most ``distance`` bits reach."""
    fps = written(fingerprints(df, text, key), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    root = components(links(distinct, distance))
    named = distinct.join(root.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return fps.join(named, "fp", "left").select(key, "fp", "component_id")


def fingerprint_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
