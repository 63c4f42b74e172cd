"""Quality scores by a factorisation machine.

A document's features are its hashed words (square roots of their counts, scaled to length 1) and standardised
statistics of its structure: lengths, shares of capitals, marks and digits, repetition of words and lines. The
score is the logistic of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. The pair sum takes linear time by
the identity sum over pairs = 1/2 sum over factors ((sum v_if x_i)^2 - sum (v_if x_i)^2).

The machine is fitted on a bounded sample of labelled documents whose features are extracted on the executors;
every whole text is then scored in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import labelled, wordscan

SAMPLE_ROWS = 12_000
PARTS, FOLD = 5, 0
THRESHOLD = 0.3
BITS = 13
RANK = 6
ROUNDS = 12
NAMES = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "letters", "capitals", "digits", "spaces", "marks", "bars", "exclamations",
    "symbols", "mark_ends", "twin_words", "distinct_words", "top_word", "repeated_lines", "short_lines", "line_ends", "same_as_next_byte",
)

_CLASS = np.zeros(256, np.int64)  # 1 letters, 2 digits, 3 spaces, 4 other marks, 5 bars, 6 exclamation marks, 7 symbols
_CLASS[33:127] = 4
_CLASS[97:123] = 1
_CLASS[65:91] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[ord("|")] = 5
_CLASS[ord("!")] = 6
_CLASS[[ord(c) for c in "#$%&*+<=>@\\^_`{}~"]] = 7


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def extract(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: statistics (texts, names), first places of their words, word buckets, word values."""
    n = len(texts)
    words = wordscan.scan(texts, ~wordscan.SPACE, lower_latin=True)
    bounds = words.bounds
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[wordscan.offsets(texts)[0] : wordscan.offsets(texts)[-1]] if len(words.data) else words.data
    size = np.maximum(np.diff(bounds), 1).astype(float)
    kinds = [_sums(_CLASS[raw] == k, bounds) / size for k in range(1, 8)]
    capital = _sums((raw >= 65) & (raw <= 90), bounds) / size
    twin_byte = np.zeros(len(raw), bool)
    twin_byte[1:] = raw[1:] == raw[:-1]

    per = words.per_doc()
    count = np.maximum(np.diff(per), 1).astype(float)
    (hashes,) = words.hashes()
    ends = _CLASS[words.data[words.end - 1]] if len(words.end) else np.zeros(0, np.int64)
    twin = np.zeros(len(hashes), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])

    lines = wordscan.scan(texts, np.arange(256) != 10, lower_latin=True)
    (line_hash,) = lines.hashes()
    line_per = lines.per_doc()
    line_count = np.maximum(np.diff(line_per), 1).astype(float)
    distinct_lines = np.bincount(_distinct(lines.doc, line_hash)[0], minlength=n)
    line_end = _CLASS[lines.data[lines.end - 1]] if len(lines.end) else np.zeros(0, np.int64)

    # words as hashed features: without their outer marks' number, each bucket once a text
    bucket = (wordscan.mix(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    owner, bucket, times = _distinct(words.doc, bucket.astype(np.uint64))
    first = np.searchsorted(owner, np.arange(n + 1))
    value = np.sqrt(times)
    norm = np.sqrt(_sums(times, first))
    value = value / np.maximum(norm[owner], 1e-9)
    most = np.zeros(n)
    np.maximum.at(most, owner, times)

    stats = np.column_stack(
        [
            np.log1p(np.diff(bounds)), np.log1p(np.diff(per)), np.log1p(np.diff(line_per)), size / count, kinds[0], capital, kinds[1], kinds[2], kinds[3],
            kinds[4], kinds[5], kinds[6], _sums(ends >= 5, per) / count, _sums(twin, per) / count, np.diff(first) / count, most / count,
            1 - distinct_lines / line_count, _sums(lines.end - lines.start < 40, line_per) / line_count, _sums(line_end == 1, line_per) / line_count,
            _sums(twin_byte, bounds) / size,
        ]
    )
    return stats, first, bucket.astype(np.int64), value


def _distinct(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key), ordered by owner, with the number of times; owners come in order."""
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    return o[at], k[at], np.diff(np.append(at, len(o)))


class Machine:
    """Parameters over word buckets followed by statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        size = (1 << BITS) + len(NAMES)
        self.mean, self.scale = mean, scale
        self.bias, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, RANK)).astype(np.float32)

    def rows(self, stats, first, bucket, value) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows of all features: places of rows, feature numbers, values."""
        n, k = len(stats), len(NAMES)
        z = np.clip((stats - self.mean) / self.scale, -6, 6) / np.sqrt(k)
        sizes = np.diff(first)
        begin = np.concatenate([[0], np.cumsum(sizes + k)])
        feature, x = np.empty(begin[-1], np.int64), np.empty(begin[-1], np.float32)
        words = np.arange(len(bucket)) + np.repeat(np.arange(n) * k, sizes)
        feature[words], x[words] = bucket, value
        tail = (begin[1:] - k)[:, None] + np.arange(k)
        feature[tail], x[tail] = (1 << BITS) + np.arange(k), z
        return begin, feature, x

    def margin(self, begin, feature, x):
        vx = self.v[feature] * x[:, None]
        one = np.add.reduceat(self.w[feature] * x, begin[:-1])
        total, squares = np.add.reduceat(vx, begin[:-1], axis=0), np.add.reduceat(vx * vx, begin[:-1], axis=0)
        return self.bias + one + 0.5 * (total * total - squares).sum(1), vx, total

    def fit(self, begin, feature, x, y, rounds: int = ROUNDS, batch: int = 64, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> None:
        """AdaGrad on the logistic loss, both classes weighted alike."""
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                rows = order[lo : lo + batch]
                size = begin[rows + 1] - begin[rows]
                at = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                f, xs, b = feature[at], x[at], np.concatenate([[0], np.cumsum(size)])
                m, vx, total = self.margin(b, f, xs)
                slope = ((1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                each = np.repeat(slope, size)
                used, where = np.unique(f, return_inverse=True)
                dw = np.bincount(where, each * xs, len(used)).astype(np.float32) + decay * self.w[used]
                inner = (np.repeat(total, size, axis=0) - vx) * (each * xs)[:, None]
                dv = np.column_stack([np.bincount(where, inner[:, r], len(used)) for r in range(RANK)]).astype(np.float32) + decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                step = float(slope.sum())
                gb += step * step
                self.bias -= rate * step / np.sqrt(gb)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = wordscan.as_bytes(batch.column(0))
        for lo, hi in wordscan.slices(texts):
            stats, first, bucket, value = extract(texts.slice(lo, hi - lo))
            cut = pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(lo, hi - lo),
                    pa.array(list(stats), pa.list_(pa.float64())),
                    pa.ListArray.from_arrays(cut, pa.array(bucket, pa.int32())),
                    pa.ListArray.from_arrays(cut, pa.array(value, pa.float32())),
                ],
                ["label", "stats", "bucket", "value"],
            )


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """A fitted machine on at most ``rows`` labelled documents; without both labels, the number that is right for all of them."""
    spark = docs.sparkSession
    known = labelled.sample(docs, labels, "quality", PARTS, FOLD, rows)
    found = known.select("text", "label").mapInArrow(_extracted, "label int, stats array<double>, bucket array<int>, value array<float>").toArrow()
    found = found.combine_chunks()
    y = found["label"].to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return spark.sparkContext.broadcast(float(y.mean()) if len(y) else 0.5)

    def flat(name: str) -> np.ndarray:
        column = found[name].combine_chunks() if isinstance(found[name], pa.ChunkedArray) else found[name]
        return column.flatten().to_numpy(zero_copy_only=False)

    stats = flat("stats").reshape(len(y), len(NAMES))
    first = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(found["bucket"]).to_numpy())])
    machine = Machine(stats.mean(0), stats.std(0) + 1e-6)
    machine.fit(*machine.rows(stats, first, flat("bucket"), flat("value")), y)
    return spark.sparkContext.broadcast((machine.mean, machine.scale, machine.bias, machine.w, machine.v))


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id, text`` to ``doc_id, score``, one row per input row.

    Null and empty texts are scored by their (empty) statistics. Repeated rows get equal scores. Scores are
    balanced: 0.5 is where both classes are equally likely if they are equally frequent.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = not isinstance(model.value, float)
        if known:
            machine = Machine(*model.value[:2])
            machine.bias, machine.w, machine.v = model.value[2:]
        for batch in batches:
            texts = wordscan.as_bytes(batch.column(1))
            out = np.zeros(len(texts))
            for lo, hi in wordscan.slices(texts):
                if not known:
                    out[lo:hi] = model.value
                    continue
                margin = machine.margin(*machine.rows(*extract(texts.slice(lo, hi - lo))))[0]
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = score(docs, train(docs, spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")))
    held_out = labelled.in_fold(F.col("doc_id"), PARTS, FOLD)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
