"""Operator 2: byte-level BPE encoding and decoding by corpus-level merge replay.

A task collects the distinct pretokens of its rows (a window of about 16 MB of
text at a time), lays their bytes out in one linked array and replays the
merges over all of them at once: an inverted index leads from the rank of a
pair to the positions where it stands; the lowest rank present is applied at
all its positions, and only the neighbours of these positions get new index
entries.  Pairs that make the same token share its rank, and so an entry: where two of
them touch, the left one goes first, as the library has it.  Texts then map pretoken
numbers to id ranges by array gathers.

The corpus of a replay is what one task reads.  One replay for the whole table
would need every occurrence of every word to be shuffled to its id list and
back, several times the input; a replay for each task shuffles nothing and
yields the same ids, as merges never cross a pretoken (figures in the README).

Very long texts are encoded whole.  An empty table gives no rows.  Nulls encode like empty texts (no ids).  Repeated rows and any further columns
pass through.  Output columns that would clash get a trailing underscore.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .flat import chunks, flat, gather, lean, strings
from .pretokens import Pool, cuts
from .store import free_name

WINDOW_BYTES = 16 << 20
POOL_WORDS = 300_000
_NONE = np.int32(2**31 - 1)


class MergeReplay:
    """The ranks of one vocabulary, and replay of its merges over many words."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        n = max(ranks.values()) + 1
        token = [b""] * n
        for t, r in ranks.items():
            token[r] = t
        self.vocab_lens = np.array([len(t) for t in token], np.int64)
        self.vocab_ends = np.cumsum(self.vocab_lens)
        self.vocab_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.int64(2**62))
        self.pair_ranks = np.append(np.array([pairs[k] for k in keys.tolist()], np.int32), _NONE)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def replay(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each word) for words laid end to end."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(lens), np.int64)
        # Position n stands for "no neighbour"; its symbol pairs with nothing.
        symbol = np.append(self.byte_ids[data], np.int32(-1))
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        ends = np.cumsum(lens)
        filled = lens > 0
        after[ends[filled] - 1] = n
        before[(ends - lens)[filled]] = n
        rank = np.full(n + 1, _NONE, np.int32)
        inside = np.flatnonzero(after[:n] < n)
        rank[inside] = self.rank_of(symbol[inside], symbol[inside + 1])
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        queue: list[int] = []
        alive = np.ones(n + 1, bool)
        alive[n] = False
        merged_now = np.zeros(n + 1, bool)

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            edge = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, p in zip(ranks[np.append(0, edge)].tolist(), np.split(positions, edge), strict=True):
                if r not in index:
                    heappush(queue, r)
                index[r].append(p)

        at = inside[rank[inside] != _NONE].astype(np.int32)
        if len(at):
            enter(at, rank[at])
        while queue:
            r = heappop(queue)
            found = index.pop(r)
            pos = found[0] if len(found) == 1 else np.concatenate(found)
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            right = after[pos]
            if (rank[right] == r).any():
                pos = self._leftmost(np.sort(pos), after)
                right = after[pos]
            beyond = after[right]
            symbol[pos] = r
            alive[right] = False
            rank[right] = _NONE
            rank[pos] = _NONE
            after[pos] = beyond
            before[beyond] = pos
            # Only pairs that touch a merged position change.
            merged_now[pos] = True
            left = before[pos]
            left = left[~merged_now[left]]
            merged_now[pos] = False
            left = left[left < n]
            touched = np.concatenate([pos, left])
            fresh = self.rank_of(symbol[touched], symbol[after[touched]])
            rank[touched] = fresh
            keep = fresh != _NONE
            if keep.any():
                enter(touched[keep], fresh[keep])
        ids = symbol[:n][alive[:n]]
        before_count = np.append(0, np.cumsum(alive[:n]))
        return ids, before_count[ends] - before_count[ends - lens]

    @staticmethod
    def _leftmost(pos: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of positions in ascending order, those that a scan from the left merges (x x x: the first pair)."""
        taken, out = -1, []
        for p in pos.tolist():
            if p != taken:
                out.append(p)
                taken = int(after[p])
        return np.array(out, pos.dtype)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets of rows) for the ids of rows laid end to end."""
        lens = self.vocab_lens[ids]
        data = self.vocab_bytes[gather(self.vocab_ends[ids] - lens, lens)]
        size = np.append(0, np.cumsum(lens))
        return data, size[np.append(0, np.cumsum(counts))]


@cache
def merges(path: str) -> MergeReplay:
    return MergeReplay(path)


#: Bytes and lengths of words to their ids and numbers of ids.
Replay = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class _Ids:
    """Id ranges of the pool's words."""

    def __init__(self, replay: Replay) -> None:
        self.replay, self.pool = replay, Pool()
        self.ids, self.lens, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self) -> None:
        data, lens = self.pool.take_new()
        ids, counts = self.replay(data, lens)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, counts])

    def of(self, code: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.lens[code]
        size = np.append(0, np.cumsum(lens))
        return self.ids[gather(self.starts[code], lens)], np.diff(size[rows])


def windows(batches: Iterator[pa.RecordBatch], column: str, replay: Replay) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids laid end to end, number of ids of each row), chunk by chunk in the order of the input."""
    state, held, size = _Ids(replay), [], 0

    def flush():
        state.extend()
        for part, code, rows in held:
            yield part, *state.of(code, rows)

    for part in chunks(batches, column):
        buf, offs = flat(part.column(column))
        starts, rows = cuts(buf, offs)
        held.append((part, state.pool.codes(buf, starts).astype(np.int32), rows))
        size += len(buf)
        if size >= WINDOW_BYTES:
            yield from flush()
            held, size = [], 0
            if len(state.pool) > POOL_WORDS:
                state = _Ids(replay)
    yield from flush()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int) of each whole text by the rank file at ``path``."""
    name = free_name(df, ids)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        for part, got, counts in windows(batches, text, merges(path).replay):
            offs = np.append(0, np.cumsum(counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offs), pa.array(got, pa.int32()))], names=[*part.schema.names, name])

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the bytes of the ids of each row (null ids: empty)."""
    name = free_name(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        bpe = merges(path)
        for b in batches:
            column = b.column(ids).fill_null([])
            counts = np.diff(column.offsets.to_numpy()).astype(np.int64)
            data, offs = bpe.decode(column.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([*b.columns, strings(data, offs)], names=[*b.schema.names, name])

    return df.mapInArrow(lean(run), schema)


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode each whole text, decode the ids, and return digests of both.

    Columns: key, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256.  One pass; neither ids nor texts leave the task.
    """
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        bpe, sha = merges(path), lambda x: hashlib.sha256(x).hexdigest()
        for part, got, counts in windows(batches, text, merges(path).replay):
            data, offs = bpe.decode(got, counts)
            ids, cut = memoryview(got.astype("<u4")).cast("B"), (4 * np.append(0, np.cumsum(counts))).tolist()
            data, offs = memoryview(np.ascontiguousarray(data)), offs.tolist()
            rows = range(len(counts))
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(counts, pa.int64()), pa.array([sha(ids[cut[i] : cut[i + 1]]) for i in rows], pa.string()), pa.array([sha(data[offs[i] : offs[i + 1]]) for i in rows], pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(key, text).mapInArrow(lean(run), schema)
