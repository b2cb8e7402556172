"""Operator 5: benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of words (lower case; split at ASCII
white space and punctuation).  An item leaks into a text if some stretch of the
text is within ``floor((1 - similarity) * words of the item)`` word edits of it.

* Windows.  Items are cut into equal pieces, of which one has no more than its share of
  the edits; a window has the length of the pieces (a length of ``LENGTHS``), and
  every word of a text starts one.  Short windows keep walks in step.
* Embedding.  A CGK walk reads a window for twice its words in steps; at each step it
  emits the word it stands at, and goes on or stays by a hash bit of that word and the
  step.  Windows that few edits part come back into step and then emit the same
  words, so few edits mean few differing places.
* Sampling.  A key is the words emitted at ``SAMPLED`` random steps of a walk.  Keys of
  the pieces are an index for each repetition, and windows meet pieces by equality of a
  key.  As many repetitions are made as the measured agreement (``AGREEMENT``) needs
  for the recall asked for, whatever their number.
* Bound.  An edit breaks two pairs of neighbouring words at most, so a window that has
  fewer pairs of the benchmark than that of a leak must have is not walked.  A candidate
  stretch that has fewer words of its item than a leak must have is passed over.
* Verification.  All other candidates are verified exactly (bit-parallel edit
  distance of the item to any part of the stretch), so no leak is reported that is none.

Items whose budget is no edit (fewer than five words at 0.8) are found by their
exact words.  Items without a word match nothing.

The benchmark is written once as a table of slices in the shared folder, and tasks
read the slice they need from there: one pass over the texts for each ``SLICE`` items,
and nothing of the benchmark passes through the driver.

Null and empty texts match nothing; very long texts are read whole, a chunk of rows at a
time.  Of equally good places of an item in a text the first found counts.  Repeated
rows give repeated results, items that repeat a key are items of their own, empty
tables give no rows.  Further columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .flat import MARKS, chunks, flat, gather, hashes, lean, mixed, spans
from .ranges import filesystem
from .store import new_folder

SLICE = 20_000
#: Words of stretches that are counted at once.
COUNTED = 1 << 20
#: Stands after the last word; a walk that reaches it emits it.
GUARD = np.array([0x5BD1E9955BD1E995], np.uint64)


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """(word keys, number of the first word of each row)."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    buf, offs = flat(pc.utf8_lower(column))
    starts, ends, first = spans(buf, offs, MARKS)
    return hashes(buf, starts, ends), first


def _grams(word: np.ndarray, q: int) -> np.ndarray:
    """Key of the q words from each position on."""
    n = len(word) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, q, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x9FB21C651E98DF25) + word[k : k + n]
    return mixed(h)


def edits(item: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of ``item`` to any stretch of ``text``, where that stretch ends)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    up, down, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


#: Lengths of windows, in words.
LENGTHS = (5, 8, 10, 12)
#: Chance that a key of a leak agrees at the bound of its edits, for a repetition.  Measured (see
#: the tests): on random words and edits it is 0.25 to 0.45; less is taken, as repetitions share walks.
AGREEMENT = 0.15
SAMPLED = 3
#: Repetitions that sample one walk.
SHARED = 3


class Walks:
    """Keys of windows: CGK walks, and the steps sampled of each."""

    def __init__(self, recall: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.repetitions = math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT))
        walks = math.ceil(self.repetitions / SHARED)
        #: A walk of its own for each group of repetitions, and a multiplier for each of the words sampled.
        self.salt = rng.integers(1, 1 << 63, walks, dtype=np.uint64)
        self.factor = rng.integers(1, 1 << 63, SAMPLED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = rng.random((self.repetitions, 2 * max(LENGTHS)))

    def steps(self, c: int, r: int) -> np.ndarray:
        """The steps of repetition ``r`` that are sampled for windows of ``c`` words: a uniform choice of the first 2c."""
        return np.sort(np.argsort(self.place[r, : 2 * c])[:SAMPLED])

    def keys(self, word: np.ndarray, at: np.ndarray, c: int) -> Iterator[np.ndarray]:
        """The key of each window that starts at ``at``, for one repetition after another.  ``word`` ends in 2c or more guards."""
        part = [word * f for f in self.factor]
        for w, salt in enumerate(self.salt):
            mine = range(w * SHARED, min((w + 1) * SHARED, self.repetitions))
            wanted = [self.steps(c, r).tolist() for r in mine]
            turn = (mixed(word ^ salt) >> np.uint64(32)).astype(np.uint32)
            key = [np.zeros(len(at), np.uint64) for _ in mine]
            place = at.copy()
            for t in range(max(x[-1] for x in wanted) + 1):
                for k, steps in enumerate(wanted):
                    if t in steps:
                        key[k] += part[steps.index(t)][place]
                place += ((turn >> np.uint32(t)) & np.uint32(1)).astype(np.uint8)[place]
            yield from key


def windows_of(m: int, d: int) -> tuple[int, int, int]:
    """(pieces, words of a window, edits) for items of ``m`` words and ``d`` edits: the cut with the least share of
    edits in the window of the piece that has the fewest; ties: the longest window, then the fewest pieces."""
    cuts = [(max([c for c in LENGTHS if c <= m // p], default=0), p) for p in range(1, max(1, m // LENGTHS[1]) + 1)]
    c, p = min((x for x in cuts if x[0]), key=lambda x: ((d // x[1]) / x[0], -x[0], x[1]))
    return p, c, d // p


class Items:
    """Pieces, keys and words of one slice of benchmark items."""

    def __init__(self, ids: list, texts: list[str], similarity: float, recall: float = 0.999, seed: int = 7) -> None:
        word, first = _words(pa.array(texts, pa.string()))
        n = np.diff(first)
        self.ids = [i for i, k in zip(ids, n, strict=True) if k]
        self.words = [word[a : a + k] for a, k in zip(first[:-1], n, strict=True) if k]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.budget = np.floor((1 - similarity) * self.size + 1e-9).astype(np.int64)
        self.walks = Walks(recall, seed)
        #: By (words of a window, edits), for each repetition: sorted keys of pieces, items, places of the pieces in them, filter.
        self.index: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        cut: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, (m, d) in enumerate(zip(self.size.tolist(), self.budget.tolist(), strict=True)):
            if d:
                parts, c, e = windows_of(m, d)
                cut.setdefault((c, e), []).extend((i, k * m // parts) for k in range(parts))
        for (c, e), pieces in sorted(cut.items()):
            item, start = np.array(pieces, np.int64).T
            # A walk may run into what follows the piece, as it does in a text.
            data = [np.append(self.words[i][a : a + 2 * c], GUARD.repeat(2 * c)) for i, a in pieces]
            size = np.array([len(x) for x in data])
            rows = []
            for key in self.walks.keys(np.concatenate(data), np.cumsum(size) - size, c):
                order = np.argsort(key, kind="stable")
                rows.append((key[order], item[order], start[order], _bloom(key)))
            self.index[c, e] = rows
        for m in sorted(set(self.size[self.budget == 0].tolist())):
            mine = np.flatnonzero((self.budget == 0) & (self.size == m))
            key = np.array([_grams(self.words[i], m)[0] for i in mine.tolist()], np.uint64)
            order = np.argsort(key, kind="stable")
            self.whole[m] = key[order], mine[order]
        of = np.repeat(np.arange(len(self.ids)), self.size)
        every = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        #: Keys of the neighbouring words of items, and of single words for windows too short for pairs.
        pairs = [_grams(w, 2) for w in self.words]
        self.known = {2: np.unique(np.concatenate(pairs)) if pairs else every, 1: np.unique(every)}
        self.filter = {q: _bloom(k) for q, k in self.known.items()}
        self.own, self.times = np.unique(self._mark(every, of), return_counts=True)
        self.marked = _bloom(self.own)

    @staticmethod
    def _mark(word: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Key of a word of an item."""
        return mixed(word + (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))

    def _enough(self, word: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether stretches [start, stop) share as many words with their item (each as often as both have it) as a leak must."""
        size, out = stop - start, np.zeros(len(item), bool)
        upto = np.cumsum(size)
        at = 0
        while at < len(item):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + COUNTED, "right")))
            n = size[at:to]
            mark = self._mark(word[gather(start[at:to], n)], np.repeat(item[at:to], n))
            own = np.flatnonzero(self.marked[(mark >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.own, mark[own]), len(self.own) - 1)
            real = self.own[place] == mark[own]
            own, place = own[real], place[real]
            of = np.repeat(np.arange(to - at), n)[own]
            least = (self.size - self.budget)[item[at:to]]
            # Most fail by the plain count.
            some = np.bincount(of, minlength=to - at) >= least
            both, times = np.unique((of * len(self.own) + place)[some[of]], return_counts=True)
            shared = np.bincount(both // len(self.own), np.minimum(times, self.times[both % len(self.own)]), to - at)
            out[at:to] = some & (shared >= least)
            at = to
        return out

    def candidates(self, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, where the item would start) of windows that share a key with a piece."""
        row, item, start = [], [], []
        upto = {}
        for (c, e), repetitions in self.index.items():
            q = 2 if c - 1 > 2 * e else 1
            if q not in upto:
                held = _held(self.filter[q], self.known[q], _grams(word, q) if q > 1 else word)
                upto[q] = np.append(np.append(0, np.cumsum(held)), np.full(q - 1, held.sum()))
            # Of the c - q + 1 places in the window each edit takes q; e more words may come in between.
            end = np.minimum(np.arange(len(word)) + c - q + 1 + e, len(word))
            at = np.flatnonzero(upto[q][end] - upto[q][:-1] >= c - q + 1 - q * e)
            if not len(at):
                continue
            row_of = np.searchsorted(first, at, "right") - 1
            if len(at) * 2 * c < len(word):  # few windows: their words alone
                data = np.append(word, GUARD)[np.minimum(at[:, None] + np.arange(2 * c), len(word))].ravel()
                begin = np.arange(len(at)) * 2 * c
            else:
                data, begin = np.append(word, GUARD.repeat(2 * c)), at
            for (key, of, off, bloom), mine in zip(repetitions, self.walks.keys(data, begin, c), strict=True):
                hit = np.flatnonzero(bloom[(mine >> np.uint64(44)).astype(np.int64)])
                a, b = np.searchsorted(key, mine[hit], "left"), np.searchsorted(key, mine[hit], "right")
                piece = gather(a, b - a)
                w = np.repeat(hit, b - a)
                row.append(row_of[w])
                item.append(of[piece])
                start.append(at[w] - off[piece])
        if not row:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(row), np.concatenate(item), np.concatenate(start)

    def matches(self, word: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, end word) of the leaks in rows of words laid end to end."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for m, (key, of) in self.whole.items():
            mine = _grams(word, m)
            a, b = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
            t = np.repeat(np.arange(len(mine)), b - a)
            i = of[gather(a, b - a)]
            r = np.searchsorted(first, t, "right") - 1
            for r_, i_, t_ in zip(r.tolist(), i.tolist(), t.tolist(), strict=True):
                if t_ + m <= first[r_ + 1] and (r_, i_) not in best and np.array_equal(word[t_ : t_ + m], self.words[i_]):
                    best[r_, i_] = 0, t_ - int(first[r_]), t_ + m - int(first[r_])
        row, item, start = self.candidates(word, first)
        if len(row):
            code = np.unique(item * np.int64(len(word) + 1) + np.maximum(start, first[row]))
            item, start = code // (len(word) + 1), code % (len(word) + 1)
            row = np.searchsorted(first, start, "right") - 1
            wide = 2 * self.budget[item]
            low, high = np.maximum(start - wide, first[row]), np.minimum(start + self.size[item] + wide, first[row + 1])
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(row))
            low, high = low[head], high[tail - 1]
            for k in np.flatnonzero(self._enough(word, item[head], low, high)).tolist():
                r, i = int(row[head[k]]), int(item[head[k]])
                m, d = int(self.size[i]), int(self.budget[i])
                if best.get((r, i), (m,))[0] == 0:
                    continue
                a = int(low[k])
                got, end = edits(self.words[i].tolist(), word[a : int(high[k])].tolist())
                if got <= d and got < best.get((r, i), (m,))[0]:
                    begins = start[head[k] : tail[k]]
                    s = int(begins[np.argmin(np.abs(begins + m - a - end))])
                    best[r, i] = got, s - int(first[r]), a + end - int(first[r])
        return [(r, i, *v) for (r, i), v in best.items()]


def _bloom(key: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(key >> np.uint64(44)).astype(np.int64)] = True
    return out


def _held(bloom: np.ndarray, sorted_keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which words are among the sorted keys."""
    out = bloom[(word >> np.uint64(44)).astype(np.int64)]
    at = np.flatnonzero(out)
    if len(at):
        out[at] = sorted_keys[np.minimum(np.searchsorted(sorted_keys, word[at]), len(sorted_keys) - 1)] == word[at]
    return out


def _slice(folder: str) -> tuple[list, list[str]]:
    """Keys and texts of a slice of the benchmark, read by a task, in an order that does not depend on its files."""
    import pyarrow.parquet as pq

    fs, base = filesystem(folder)
    from pyarrow.fs import FileSelector

    files = sorted(f.path for f in fs.get_file_info(FileSelector(base)) if f.path.endswith(".parquet"))
    got = sorted(((x["_key"], x["_text"] or "") for f in files for x in pq.read_table(fs.open_input_file(f)).to_pylist()), key=lambda x: (x[0] is not None, x[0], x[1]))
    return [k for k, _ in got], [t for _, t in got]


def _dealt(items: DataFrame, item_text: str, item_key: str) -> tuple[str, list[int]]:
    """Write the benchmark in slices to the shared folder: (folder, numbers of the slices that have items)."""
    slices = max(1, math.ceil(items.count() / SLICE))
    folder = new_folder(items.sparkSession, "benchmark")
    rows = items.select(F.col(item_key).alias("_key"), F.col(item_text).alias("_text"), F.pmod(F.xxhash64(item_key, item_text), F.lit(slices)).alias("slice"))
    rows.repartition(slices, "slice").write.partitionBy("slice").parquet(folder)
    return folder, sorted(x["slice"] for x in items.sparkSession.read.parquet(folder).select("slice").distinct().collect()) if items.take(1) else []


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", similarity: float = 0.8, recall: float = 0.999, seed: int = 7) -> DataFrame:
    """(key, item key, item_words, edits, first_word, end_word, similarity): each benchmark item in each text, at its best place."""
    schema = T.StructType([docs.schema[key], items.schema[item_key], *(T.StructField(c, T.LongType()) for c in ("item_words", "edits", "first_word", "end_word")), T.StructField("similarity", T.DoubleType())])
    folder, slices = _dealt(items, item_text, item_key)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:6]]

    def one(k: int) -> DataFrame:
        def run(batches):
            bench = Items(*_slice(f"{folder}/slice={k}"), similarity, recall, seed)
            for part in chunks(batches, text):
                hits = bench.matches(*_words(part.column(text))) if bench.ids else []
                row, item, edit, start, end = zip(*hits, strict=True) if hits else [[]] * 5
                size = [int(bench.size[i]) for i in item]
                columns = [[bench.ids[i] for i in item], size, edit, start, end]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array([1 - e / m for e, m in zip(edit, size, strict=True)], pa.float64())],
                    names=schema.names,
                )

        return docs.select(key, text).mapInArrow(lean(run), schema)

    if not slices:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, map(one, slices))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", similarity: float = 0.8, recall: float = 0.999, seed: int = 7) -> DataFrame:
    """The rows, with all columns, that no item leaks into; a pass for each slice, in which leaks leave as they are found, so no text is shuffled."""
    folder, slices = _dealt(items, item_text, item_key)

    def without(rows: DataFrame, k: int) -> DataFrame:
        def run(batches):
            bench = Items(*_slice(f"{folder}/slice={k}"), similarity, recall, seed)
            for part in chunks(batches, text):
                keep = np.ones(part.num_rows, bool)
                if bench.ids:
                    keep[[h[0] for h in bench.matches(*_words(part.column(text)))]] = False
                yield part.filter(pa.array(keep))

        return rows.mapInArrow(lean(run), docs.schema)

    return reduce(without, slices, docs)
