"""Operator 8: a factorisation machine as quality classifier.

    score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2])

The features of a text are its distinct words, hashed (x = 1 / sqrt(number of
distinct words)), and its structure statistics and numeric metadata, each cut
into levels with one indicator for each level (x = 1).  The second sum is the
usual identity for all pairwise products, so scoring is linear in the features.

The weights are learned by mini-batch AdaGrad from at most about ``SAMPLE``
labelled rows, taken by a hash of the key; they are a table of fixed size that
goes to every task.  Labels, language, source and key are never features.

Null and empty texts have structure features only, and so a score like any other;
very long texts are read whole, a chunk of rows at a time.  Rows that repeat a key are
scored each; for learning, one row of a key counts (the least by its features) and one
label of a key (the greatest), so repeats cannot outgrow the sample.  Rows and labels without a key
teach nothing.  Equal texts have equal scores.  An empty table of labels gives a score of
0.5 throughout; an empty table no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import LOWER, MARKS, chunks, flat, hashes, lean, spans

WORDS = 1 << 16
LEVELS = 24
SAMPLE = 12_000
FACTORS = 8

_KIND = {
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "digit": list(range(48, 58)),
    "symbol": [ord(c) for c in "#*$%&|<>"],
    "shout": [ord("!")],
    "stop": [ord(c) for c in ".?,;:"],
    "line": [10],
    "space": [32, 9, 11, 12, 13],
    "far": list(range(128, 256)),
}
STRUCTURE = ("length", "words", "word_length", *_KIND, "distinct", "line_length", "same_lines", "top_word")


def _row_sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return np.diff(total[offs])


def features(batch: pa.RecordBatch, text: str, metadata: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket of each distinct word, number of the first one of each row, their x, structure features of each row)."""
    buf, offs = flat(batch.column(text))
    size = np.diff(offs).astype(np.float64)
    starts, ends, first = spans(buf, offs, MARKS)
    n = np.diff(first)
    h = hashes(LOWER[buf], starts, ends)
    row = np.repeat(np.arange(len(n)), n)
    bucket = (h >> np.uint64(48)).astype(np.int64)
    pair, times = np.unique(row * WORDS + bucket, return_counts=True)
    row_of, word = pair // WORDS, pair % WORDS
    at = np.searchsorted(row_of, np.arange(len(n) + 1))
    distinct = np.diff(at)
    x = 1 / np.sqrt(np.maximum(distinct, 1))[row_of]
    top = np.zeros(len(n))
    some = np.flatnonzero(distinct)
    if len(some):
        top[some] = np.maximum.reduceat(times, at[some])
    # Lines of a row by hash: how many repeat an earlier one.
    line = np.zeros(256, bool)
    line[10] = True
    ls, le, lfirst = spans(buf, offs, line)
    lines = np.diff(lfirst)
    lrow = np.repeat(np.arange(len(n)), lines)
    lh = hashes(buf, ls, le)
    order = np.lexsort((lh, lrow))
    again = (lrow[order][1:] == lrow[order][:-1]) & (lh[order][1:] == lh[order][:-1])
    same = np.bincount(lrow[order][1:][again], minlength=len(n)) if len(order) else np.zeros(len(n))
    word_bytes = np.bincount(row, weights=(ends - starts).astype(np.float64), minlength=len(n))
    share = lambda a, b: a / np.maximum(b, 1)
    log = lambda v: np.log1p(v) * 2
    values = [log(size), log(n), share(word_bytes, n) * 2]
    table = np.zeros(256, np.uint8)
    for k, members in enumerate(_KIND.values()):
        table[members] = k + 1
    kind = table[buf]
    for k in range(len(_KIND)):
        values.append(np.log1p(1000 * share(_row_sums(kind == k + 1, offs), size)) * 3)
    values += [share(distinct, n) * (LEVELS - 1), log(share(size, lines)), share(same, lines) * (LEVELS - 1), np.log1p(100 * share(top, n)) * 4]
    for name in metadata:
        number = batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
        values.append(log(np.maximum(np.nan_to_num(number, nan=0.0), 0)))
    levels = np.clip(np.stack(values, axis=1), 0, LEVELS - 1).astype(np.int64)
    return word, at, x.astype(np.float32), WORDS + np.arange(levels.shape[1]) * LEVELS + levels


@dataclass
class Machine:
    """Weights of a factorisation machine; ``table`` holds w and the factors v of each feature."""

    bias: float
    table: np.ndarray

    def raw(self, word: np.ndarray, at: np.ndarray, x: np.ndarray, structure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score before the sigmoid, sums of v x) of each row."""
        sums = self.table[structure].sum(axis=1, dtype=np.float64)
        squares = (self.table[structure][:, :, 1:] ** 2).sum(axis=(1, 2), dtype=np.float64)
        some = np.flatnonzero(np.diff(at))
        if len(some):
            got = self.table[word] * x[:, None]
            sums[some] += np.add.reduceat(got, at[some], axis=0)
            squares[some] += np.add.reduceat(np.einsum("ij,ij->i", got[:, 1:], got[:, 1:]), at[some])
        return self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares), sums[:, 1:]

    def score(self, *of) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*of)[0], -40, 40)))


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], n_structure: int, epochs: int = 8, rate: float = 0.08, decay: float = 1e-5, seed: int = 11, batch: int = 64) -> Machine:
    """Learn from (label, word buckets, structure features) rows, in the order given."""
    rng = np.random.default_rng(seed)
    size = WORDS + n_structure * LEVELS
    table = rng.normal(0, 0.01, (size, 1 + FACTORS)).astype(np.float32)
    table[:, 0] = 0
    m = Machine(0.0, table)
    speed, bias_speed = np.full(table.shape, 1e-6, np.float32), 1e-6
    label = np.array([s[0] for s in samples], np.float64)
    if not len(label):
        return m
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    m.bias = float(np.log(share / (1 - share)))
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for b in range(0, len(order), batch):
            pick = order[b : b + batch]
            n = np.array([len(samples[i][1]) for i in pick])
            at = np.append(0, np.cumsum(n))
            word = np.concatenate([samples[i][1] for i in pick])
            structure = np.stack([samples[i][2] for i in pick])
            row = np.repeat(np.arange(len(pick)), n)
            x = (1 / np.sqrt(np.maximum(n, 1)))[row].astype(np.float32)
            raw, sums = m.raw(word, at, x, structure)
            error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - label[pick]) / len(pick)
            m.bias -= rate * error.sum() / np.sqrt(bias_speed := bias_speed + error.sum() ** 2)
            feature = np.concatenate([word, structure.ravel()])
            of = np.concatenate([row, np.repeat(np.arange(len(pick)), structure.shape[1])])
            value = np.concatenate([x, np.ones(structure.size, np.float32)])
            slope = (error[of] * value)[:, None]
            grad = np.concatenate([slope, slope * (sums[of] - m.table[feature][:, 1:] * value[:, None])], axis=1)
            uniq, inverse = np.unique(feature, return_inverse=True)
            total = np.stack([np.bincount(inverse, weights=grad[:, c], minlength=len(uniq)) for c in range(grad.shape[1])], axis=1)
            total += decay * m.table[uniq]
            speed[uniq] += total**2
            m.table[uniq] -= (rate * total / np.sqrt(speed[uniq])).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE) -> Machine:
    """Learn from the labelled rows of ``docs``; ``labels`` has the key and the label."""
    labels = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k IS NOT NULL AND _y IS NOT NULL").groupBy("_k").agg(F.max("_y").alias("_y"))
    n = labels.count()
    if n > sample:
        labels = labels.where(F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    # At most about `sample` rows of two numbers.
    docs = docs.select(key, text, *metadata)
    rows = docs.join(F.broadcast(labels), docs[key] == labels["_k"]).select("_k", "_y", text, *metadata)

    def run(batches):
        for part in chunks(batches, text):
            word, at, _, structure = features(part, text, metadata)
            yield pa.RecordBatch.from_arrays(
                [part.column("_k"), part.column("_y"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(word.astype(np.int32))), pa.ListArray.from_arrays(pa.array(np.arange(len(structure) + 1, dtype=np.int32) * structure.shape[1]), pa.array(structure.ravel().astype(np.int32)))],
                names=["k", "y", "word", "structure"],
            )

    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("y", T.IntegerType()), T.StructField("word", T.ArrayType(T.IntegerType())), T.StructField("structure", T.ArrayType(T.IntegerType()))])
    once = rows.mapInArrow(lean(run), schema).groupBy("k").agg(F.min(F.struct("y", "word", "structure")).alias("s")).select("k", "s.*")
    got = once.toArrow().sort_by("k")
    y, word, structure = got["y"].to_numpy(), got["word"].combine_chunks(), got["structure"].combine_chunks()
    word, structure = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in (word, structure))
    w_at, w = word.offsets.to_numpy(), word.values.to_numpy()
    s_at, s = structure.offsets.to_numpy(), structure.values.to_numpy()
    samples = [(int(y[i]), w[w_at[i] : w_at[i + 1]], s[s_at[i] : s_at[i + 1]]) for i in range(len(y))]
    return train(samples, len(STRUCTURE) + len(metadata))


def score(df: DataFrame, machine: Machine, text: str = "text", metadata: tuple[str, ...] = ("n_chars",), keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """(columns of ``keep``, out): the score of each whole text."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType())])

    def run(batches):
        for part in chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(machine.score(*features(part, text, metadata)))], names=schema.names)

    return df.select(*dict.fromkeys((*keep, text, *metadata))).mapInArrow(lean(run), schema)


def keep(df: DataFrame, machine: Machine, least: float = 0.3, text: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """The rows, with all columns, whose score is at least ``least``; one pass, no join."""

    def run(batches):
        for part in chunks(batches, text):
            yield part.filter(pa.array(machine.score(*features(part, text, metadata)) >= least))

    return df.mapInArrow(lean(run), df.schema)


def held_out(key: str = "doc_id", folds: int = 5):
    return F.crc32(F.col(key).cast("string")) % folds == 0
