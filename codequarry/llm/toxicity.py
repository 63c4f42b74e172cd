"""Toxicity by maximum-scoring segment search over token log-odds.

Training: in a bounded sample of labelled documents, count in how many toxic and clean ones each word and each
word beginning of 3 to 6 letters occurs. A word's toxic share has a Dirichlet prior whose mean is the share of
its 7-letter beginning, whose prior is that of its 6-letter beginning, and so on up to the share over all
words; so an unseen form of a known stem gets the stem's odds. A token scores the log-odds of its share
against the share over all words, less ``DRIFT``, so that clean prose sums to less and less.

Search: one linear pass over a document's running sum finds all maximal-scoring segments (Ruzzo and Tompa). Every
token scores in it, so a passage is found wherever it stands. A word that repeats within such a segment is no new
evidence there: a second pass over the segment alone, where repeats that speak for toxicity score 0, gives the passages.

Calibration: best segments of clean documents follow an extreme-value law; its two parameters are fitted by
maximum likelihood and turn a segment's score into the number of equally good ones to expect by chance in a
text of that length. A logistic fit on the best and the summed evidence gives the probability. Both use
scores of documents by a model that was trained on the other half of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import labelled, wordscan

SAMPLE_ROWS = 30_000
PARTS, FOLD = 4, 2
THRESHOLD = 0.3
BITS = 20
STRETCH = 14
PREFIXES = [3, 4, 5, 6, 7]
PRIOR = 16.0
DRIFT = 1.0
MOST_PASSAGES = 1.0  # a passage is significant if chance gives at most so many as good in the text


def features(texts: pa.Array) -> tuple[wordscan.Words, np.ndarray]:
    """The words of texts, and the buckets of each word's beginnings and of the word itself (levels, words)."""
    words = wordscan.scan(texts, wordscan.LETTER, lower_latin=True)
    hashes = words.hashes(*words.prefix_ends(PREFIXES), words.end)
    levels = [wordscan.mix(h + np.uint64(i + 1)) >> np.uint64(64 - BITS) for i, h in enumerate(hashes)]
    return words, np.array(levels, np.int64).reshape(len(hashes), -1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        texts, label, half = wordscan.as_bytes(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for lo, hi in wordscan.slices(texts):
            words, buckets = features(texts.slice(lo, hi - lo))
            for row in buckets:
                seen = np.unique(words.doc << BITS | row)
                doc, bucket = seen >> BITS, seen & ((1 << BITS) - 1)
                for key in {(int(a), int(b)) for a, b in zip(label[lo:hi], half[lo:hi], strict=True)}:
                    own = (label[lo:hi][doc] == key[0]) & (half[lo:hi][doc] == key[1])
                    total.setdefault(key, np.zeros(1 << BITS, np.int64))
                    total[key] += np.bincount(bucket[own], minlength=1 << BITS)
    for (label_, half_), counts in total.items():
        bucket = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(bucket), label_, np.int32)), pa.array(np.full(len(bucket), half_, np.int32)), pa.array(bucket), pa.array(counts[bucket])],
            ["label", "half", "bucket", "n"],
        )


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros((2, 2, 1 << STRETCH), np.int32)
    at = rows["bucket"].to_numpy() & ((1 << STRETCH) - 1)
    for i in (0, 1):
        for h in (0, 1):
            out[i, h, at] = rows[f"n{i}{h}"].to_numpy()
    return pd.DataFrame({"stretch": rows["stretch"].iloc[:1], "counts": [out.tobytes()]})


class Odds:
    """Token scores from counts per bucket; ``level`` counts are summed over all levels, which have buckets of their own."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray):
        self.toxic, self.both = toxic.astype(np.float32), (toxic + clean).astype(np.float32)
        self.share = (float(toxic.sum()) + 0.5) / (float(self.both.sum()) + 1.0)

    def tokens(self, buckets: np.ndarray) -> np.ndarray:
        """Scores of words, each by itself."""
        share = np.full(buckets.shape[1], self.share, np.float32)
        for row in buckets:
            share = (self.toxic[row] + PRIOR * share) / (self.both[row] + PRIOR)
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share)) - np.log(self.share / (1 - self.share)) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments as (score, first, last) in order, in time linear in the number of scores."""
    after = np.cumsum(scores, dtype=np.float64)
    left: list[float] = []
    right: list[float] = []
    first: list[int] = []
    last: list[int] = []
    lower: list[int] = []  # the nearest earlier candidate that begins at a smaller sum
    for at in np.flatnonzero(scores > 0).tolist():
        r = float(after[at])
        l, begin = r - float(scores[at]), at
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j = lower[j]
            if j < 0 or right[j] >= r:
                break
            l, begin = left[j], first[j]
            del left[j:], right[j:], first[j:], last[j:], lower[j:]
        left.append(l)
        right.append(r)
        first.append(begin)
        last.append(at)
        lower.append(j)
    return [(r - l, a, b) for l, r, a, b in zip(left, right, first, last, strict=True)]


def passages(scores: np.ndarray, words: np.ndarray) -> list[tuple[float, int, int]]:
    """The maximal-scoring segments in which each of ``words`` speaks for toxicity once: (score, first, last) in order."""
    out = []
    for score, first, last in segments(scores):
        own, word = scores[first : last + 1], words[first : last + 1]
        up = np.flatnonzero(own > 0)
        new = np.unique(word[up], return_index=True)[1]
        if len(new) == len(up):
            out.append((score, first, last))
            continue
        once = np.minimum(own, 0)
        once[up[new]] = own[up[new]]
        out += [(s, first + a, first + b) for s, a, b in segments(once)]
    return out


def _evidence(length: int, found: list[tuple[float, int, int]], law: tuple[float, float]) -> tuple[float, float]:
    """Of the best segment and of all that are significant: minus the log of the number to expect by chance."""
    rate, size = law
    each = [rate * s - np.log(size * max(length, 1)) for s, _, _ in found]
    return max(each, default=-np.log(size * max(length, 1)) - 1.0), sum(max(0.0, x) for x in each)


def gumbel(best: np.ndarray, length: np.ndarray) -> tuple[float, float]:
    """Rate and size of the extreme-value law of best scores, by maximum likelihood (one-dimensional search)."""
    if len(best) == 0:
        return 1.0, 1.0
    length = np.maximum(length, 1)
    top, law = -np.inf, (1.0, 1.0)
    for rate in np.geomspace(0.05, 5, 120):
        size = len(best) / np.sum(length * np.exp(-rate * best))
        likely = len(best) * (np.log(rate) + np.log(size)) - rate * best.sum() - len(best)
        if likely > top:
            top, law = likely, (float(rate), float(size))
    return law


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression with intercept, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def squash(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip(best, -20, 40), np.log1p(np.clip(total, 0, None))])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """The model: bucket counts, the extreme-value law and the logistic weights (None without both labels)."""
    spark = docs.sparkSession
    wordscan.small_batches(spark)
    known = labelled.sample(docs, labels, "toxic", PARTS, FOLD, rows)
    counted = known.select("text", "label", "half").mapInArrow(_counts, "label int, half int, bucket long, n long")
    cell = [F.sum(F.when((F.col("label") == i) & (F.col("half") == h), F.col("n")).otherwise(0)).cast("int").alias(f"n{i}{h}") for i in (0, 1) for h in (0, 1)]
    counted = counted.groupBy("bucket").agg(*cell)
    # all counts, as one row of packed numbers per stretch of buckets: 2^BITS * 16 bytes at most
    stretch = F.shiftright("bucket", STRETCH).cast("int").alias("stretch")
    packed = counted.select(stretch, "*").groupBy("stretch").applyInPandas(_packed, "stretch int, counts binary").collect()
    counts = np.zeros((2, 2, 1 << BITS), np.int32)
    for r in packed:
        at = r["stretch"] << STRETCH
        counts[:, :, at : at + (1 << STRETCH)] = np.frombuffer(r["counts"], np.int32).reshape(2, 2, -1)
    del packed
    if not counts[0].any() or not counts[1].any():
        return None
    halves = spark.sparkContext.broadcast(counts)

    def crossed(law: tuple[float, float] | None):
        """Length and best segment of each text, by the model of the other half; with a law, its evidence."""

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = [Odds(halves.value[1, 1 - h], halves.value[0, 1 - h]) for h in (0, 1)]
            for batch in batches:
                texts, half = wordscan.as_bytes(batch.column(0)), batch.column(2).to_numpy()
                out = []
                for lo, hi in wordscan.slices(texts):
                    words, buckets = features(texts.slice(lo, hi - lo))
                    per, scores = words.per_doc(), [m.tokens(buckets) for m in models]
                    for i in range(hi - lo):
                        found = passages(scores[half[lo + i]][per[i] : per[i + 1]], buckets[-1][per[i] : per[i + 1]])
                        n = int(per[i + 1] - per[i])
                        out.append((max((s for s, _, _ in found), default=0.0), float(n)) if law is None else _evidence(n, found, law))
                columns = [batch.column(1), *(pa.array([x[k] for x in out], pa.float64()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["label", "x", "y"])
            wordscan.give_back()

        return scored

    def facts(law: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = known.select("text", "label", "half").mapInArrow(crossed(law), "label int, x double, y double").toArrow()  # 20 bytes a row
        return tuple(seen[c].to_numpy() for c in ("label", "x", "y"))

    y, best, length = facts(None)
    law = gumbel(best[(y == 0) & (best > 0)], length[(y == 0) & (best > 0)])
    y, strongest, total = facts(law)
    weights = logistic(squash(strongest, total), y)
    halves.destroy()
    toxic, clean = counts[1].sum(0, dtype=np.int32), counts[0].sum(0, dtype=np.int32)
    return spark.sparkContext.broadcast((toxic, clean, law, weights))


class Judge:
    """A trained model, ready to read batches of texts in a task."""

    def __init__(self, model):
        self.known = model is not None
        if self.known:
            toxic, clean, self.law, self.weights = model.value
            self.odds = Odds(toxic, clean)

    def read(self, texts: pa.Array, spans: bool = True) -> tuple[np.ndarray, list[list[dict]]]:
        """The probability of each text, and (with ``spans``) its significant passages (bytes of the text, end exclusive)."""
        significant: list[list[dict]] = [[] for _ in range(len(texts))]
        if not self.known:
            return np.zeros(len(texts)), significant
        texts, facts = wordscan.as_bytes(texts), np.zeros((len(texts), 2))
        for lo, hi in wordscan.slices(texts):
            words, buckets = features(texts.slice(lo, hi - lo))
            per, scores = words.per_doc(), self.odds.tokens(buckets)
            for i in range(hi - lo):
                a, b = int(per[i]), int(per[i + 1])
                found = passages(scores[a:b], buckets[-1][a:b])
                facts[lo + i] = _evidence(b - a, found, self.law)
                for s, first, last in found if spans else ():
                    chance = self.law[1] * (b - a) * np.exp(-self.law[0] * s)
                    if chance <= MOST_PASSAGES:
                        span = (words.start[a + first] - words.bounds[i], words.end[a + last] - words.bounds[i])
                        significant[lo + i].append({"start": int(span[0]), "end": int(span[1]), "chance": float(chance)})
        x = np.column_stack([np.ones(len(facts)), squash(facts[:, 0], facts[:, 1])])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), significant


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id, text`` to ``doc_id, score, n_passages, passages``, one row per input row.

    ``passages`` are the significant ones' first and last byte in the UTF-8 text (end exclusive) with the
    number of equally good ones to expect by chance. Null and empty texts have no passage and get the score
    of a text without evidence. Repeated rows get equal scores. Without a model (no labels) scores are 0.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))
        for batch in batches:
            chance, found = judge.read(batch.column(1))
            columns = [batch.column(0), pa.array(chance), pa.array([len(p) for p in found], pa.int32()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_passages", "passages"])
        wordscan.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, n_passages int, passages array<struct<start:bigint,end:bigint,chance:double>>"
    return docs.select("doc_id", "text").mapInArrow(scored, schema)


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = score(docs, train(docs, spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")))
    held_out = labelled.in_fold(F.col("doc_id"), PARTS, FOLD)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of the documents whose score stays below the threshold.

    Rows are kept or dropped by their own text: the same batch carries the whole row, so ids may repeat or be null.
    """
    model = train(docs, labels, rows)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for batch in batches:
            yield batch.filter(pa.array(judge.read(batch.column(at), spans=False)[0] < THRESHOLD))
        wordscan.give_back()

    return docs.mapInArrow(kept, docs.schema)
