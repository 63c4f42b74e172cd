"""Benchmark decontamination with suffix arrays over the training texts.

Each task cuts its texts into shards of some megabytes and builds a suffix array over a shard's words: the places of
all words in the order of what follows them in the same text. All suffixes of all benchmark items are then looked up
by binary search, word after word: the places that go on like a suffix for d words are a stretch of the array, and the
next word narrows the stretch. A stretch that is left after a window's words holds the places of all verbatim
occurrences; going on until no place is left gives the longest match.

Words that occur in no benchmark item end a suffix like a text's end does, as no match goes over them, and stretches of
other words that are shorter than the shortest window are left out. Words are found by 64-bit hash in the benchmark's
vocabulary and then compared byte by byte.

Benchmark items are sent to the tasks in blocks of ``BLOCK`` bytes, one pass over the documents for each block, whose
results travel along with the rows. So what is broadcast is bounded however large the benchmark is, and nothing about
documents reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codequarry.llm import wordscan
from codequarry.llm.prefix import prefix_sums
from codequarry.sources.store import settle

WINDOW = 10
BLOCK = 4 << 20  # bytes of benchmark text for each pass over the documents
SHARD = 2 << 20  # bytes of training text of a suffix array

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
_PREFIX = "_state_"
_STATE = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<bigint>, longest bigint"


def suffix_array(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` in the order of the words that follow them.

    ``words`` are numbers from 1; 0 ends a suffix, and there is one behind every place. Prefix doubling: a place's rank among the
    beginnings of h words, with the rank h words further on, gives its rank among beginnings of 2h words. Only places
    that still share their rank are sorted again. Suffixes that are equal up to their 0 stay in the order of ``places``.
    """
    n = len(places)
    if not n:
        return places
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    rank = np.zeros(len(words) + 1, np.int64)  # 0 for ends; else 1 + the place in the order of the first that is alike
    rank[order] = _firsts(key) + 1
    done = np.zeros(len(words) + 1, bool)
    step = 1
    tied = np.flatnonzero(_shared(rank[order]))
    while len(tied):
        here = order[tied]
        further = np.where(rank[here] > 0, rank[np.minimum(here + step, len(words))], 0)
        done[here] |= further == 0  # the suffix ends within the words looked at
        fresh = np.lexsort((further, rank[here]))
        here, further = here[fresh], further[fresh]
        order[tied] = here  # groups keep their stretch of the order
        old = rank[here]
        new = np.empty(len(here), bool)
        new[:1] = True
        new[1:] = (old[1:] != old[:-1]) | (further[1:] != further[:-1])
        rank[here] = tied[np.maximum.accumulate(np.where(new, np.arange(len(here)), 0))] + 1
        left = _shared(rank[here]) & ~done[here]
        tied = tied[left]
        step *= 2
    return order


def _firsts(values: np.ndarray) -> np.ndarray:
    """For sorted values the place of the first equal one."""
    new = np.empty(len(values), bool)
    new[:1] = True
    new[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def _shared(values: np.ndarray) -> np.ndarray:
    """Which of sorted values have an equal neighbour."""
    out = np.zeros(len(values), bool)
    same = values[1:] == values[:-1]
    out[1:] = same
    out[:-1] |= same
    return out


class Shard:
    """Words of some texts, as numbers of a vocabulary (0: none of it, or the end of a text), and their suffix array."""

    def __init__(self, words: np.ndarray, shortest: int):
        self.words = np.append(words, 0).astype(np.int64)
        ends = np.flatnonzero(self.words == 0)
        run = np.diff(np.append(-1, ends)) - 1  # words before each 0
        long = np.repeat(run >= shortest, run + 1)
        self.order = suffix_array(self.words, np.flatnonzero((self.words > 0) & long))

    def narrow(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of stretches [low, high), alike in ``depth`` words, whose next word is ``word``."""
        edges = []
        for above in (0, 1):  # the first place whose next word is at least word, and the first above it
            a, b = low.copy(), high.copy()
            while (a < b).any():
                open_ = a < b
                middle = (a + b) // 2
                # a closed stretch may point behind its end, at a suffix of fewer words
                at = self.words[np.minimum(self.order[np.minimum(middle, len(self.order) - 1)] + depth, len(self.words) - 1)]
                less = open_ & (at < word + above)
                a, b = np.where(less, middle + 1, a), np.where(open_ & ~less, middle, b)
            edges.append(a)
        return edges[0], edges[1]


class Block:
    """Some benchmark items, ready to be looked up in shards."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, window: int):
        texts = wordscan.as_bytes(texts)
        words = wordscan.scan(texts, WORD)
        (hashes,) = words.hashes()
        self.vocabulary, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.size = (words.end - words.start)[first]  # of the vocabulary's words, in bytes
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = words.data[_members(words.start[first], words.end[first])]
        per, self.ids = words.per_doc(), ids
        length = np.diff(per)
        self.need = np.minimum(window, np.repeat(length, length))  # words of a window at this place of its item
        left = np.repeat(per[1:], length) - np.arange(len(number))
        # 0 behind each item, so that a suffix ends with its item
        self.words = np.zeros(len(number) + len(texts), np.int64)
        self.item = np.repeat(np.arange(len(texts)), length)
        at = np.arange(len(number)) + self.item
        self.words[at] = number + 1
        starts = np.flatnonzero(left >= self.need)  # suffixes that hold a whole window
        self.starts, self.need, self.item = at[starts], self.need[starts], self.item[starts]
        self.shortest = int(self.need.min()) if len(starts) else 0

    def numbers(self, words: wordscan.Words) -> np.ndarray:
        """Vocabulary numbers of words (from 1; 0: not in it)."""
        (hashes,) = words.hashes()
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def look_up(self, shard: Shard) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By rising number of words: (words, suffixes, first and end of their stretch) as long as any suffix has a stretch."""
        which, depth = np.arange(len(self.starts)), 0
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(shard.order))
        while len(which):
            word = self.words[self.starts[which] + depth]
            low, high = shard.narrow(low, high, depth, word)
            depth += 1
            found = (low < high) & (word > 0)
            which, low, high = which[found], low[found], high[found]
            if len(which):
                yield depth, which, low, high


def _stretches(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ones of stretches that are alike or apart, and for each stretch the number of its distinct one."""
    first, index, number = np.unique(low, return_index=True, return_inverse=True)
    return first, high[index], number


def _members(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of stretches that are apart, one stretch after the other."""
    size = high - low
    return np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


class Result:
    """What one shard's texts have of a block: words that are hit, items, and the longest match, per text."""

    def __init__(self, block: Block, texts: pa.Array):
        words = wordscan.scan(texts, WORD)
        self.per = words.per_doc()
        n = len(texts)
        self.items: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.longest = np.zeros(n, np.int64)
        # a 0 behind each text: no match goes over its end
        at = np.arange(len(words.start)) + words.doc
        numbers = np.zeros(len(words.start) + n, np.int64)
        numbers[at] = _verified(block, words, block.numbers(words))
        origin = np.repeat(np.arange(n), np.diff(self.per) + 1)
        cover = np.zeros(len(numbers) + 1, np.int64)
        pairs = []
        if block.shortest and len(words.start):
            shard = Shard(numbers, block.shortest)
            for depth, which, low, high in block.look_up(shard):
                if depth < block.shortest:
                    continue
                whole = block.need[which] <= depth
                first, end, _ = _stretches(low[whole], high[whole])
                np.maximum.at(self.longest, origin[shard.order[_members(first, end)]], depth)
                now = block.need[which] == depth
                first, end, kind = _stretches(low[now], high[now])
                if len(first):
                    places = shard.order[_members(first, end)]
                    np.add.at(cover, places, 1)
                    np.add.at(cover, places + depth, -1)
                    of = np.repeat(np.arange(len(first)), end - first)
                    pairs.append((origin[places], of, kind, block.item[which[now]]))
        hit = np.cumsum(cover)[at] > 0
        self.hits = hit
        self._gather(pairs, block)

    def _gather(self, pairs, block: Block) -> None:
        """Items of each text: the union over its stretches of the items that look for them."""
        mine: dict[int, list[np.ndarray]] = {}
        for text, stretch, kind, item in pairs:
            both = np.unique(text * (int(stretch.max()) + 1) + stretch)
            text, stretch = np.divmod(both, int(stretch.max()) + 1)
            order = np.argsort(kind, kind="stable")
            item, begin = item[order], np.searchsorted(kind[order], np.arange(int(kind.max()) + 2))
            edge = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            for lo, hi in zip(edge, np.append(edge[1:], len(text)), strict=True):
                own = [item[begin[s] : begin[s + 1]] for s in stretch[lo:hi]]
                mine.setdefault(int(text[lo]), []).append(np.unique(np.concatenate(own)))
        for text, found in mine.items():
            self.items[text] = np.unique(block.ids[np.concatenate(found)])

    def spans(self, i: int) -> list[tuple[int, int]]:
        """Stretches of words (first, last) of text ``i`` that are hit."""
        hit = np.diff(np.concatenate([[0], self.hits[self.per[i] : self.per[i + 1]].astype(np.int8), [0]]))
        return list(zip(np.flatnonzero(hit == 1).tolist(), (np.flatnonzero(hit == -1) - 1).tolist(), strict=True))


def _verified(block: Block, words: wordscan.Words, numbers: np.ndarray) -> np.ndarray:
    """``numbers``, with 0 where a word only shares a hash with the vocabulary's word."""
    known = np.flatnonzero(numbers)
    if not len(known):
        return numbers
    length, begin = (words.end - words.start)[known], block.begin[numbers[known] - 1]
    wrong = length != block.size[numbers[known] - 1]
    good = np.flatnonzero(~wrong)
    for lo in range(0, len(good), 1 << 16):
        part = good[lo : lo + (1 << 16)]
        here = _members(words.start[known[part]], words.start[known[part]] + length[part])
        there = _members(begin[part], begin[part] + length[part])
        differ = words.data[here] != block.bytes[there]
        if differ.any():
            wrong[part[np.repeat(np.arange(len(part)), length[part])[differ]]] = True
    out = numbers.copy()
    out[known[wrong]] = 0
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(sent, window: int, schema: pa.Schema):
    """Rows with state columns to rows of ``schema``, whose state includes one more block."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = sent.value
        block = Block(np.asarray(ids, np.int64), pa.array(texts, pa.string()), window)
        for batch in batches:
            whole = wordscan.as_bytes(pa.compute.fill_null(batch.column("text"), ""))
            for lo, hi in wordscan.slices(whole, SHARD):
                part = batch.slice(lo, hi - lo)
                found = Result(block, whole.slice(lo, hi - lo))
                spans, items, longest = [found.spans(i) for i in range(hi - lo)], [x.tolist() for x in found.items], found.longest
                if part.column(_PREFIX + "spans").null_count < len(part):  # an earlier block's state
                    before = {name: part.column(_PREFIX + name).to_pylist() for name in ("spans", "items", "longest")}
                    spans = [_merged(s + [(x["first"], x["last"]) for x in o]) for s, o in zip(spans, before["spans"], strict=True)]
                    items = [sorted({*i, *o}) for i, o in zip(items, before["items"], strict=True)]
                    longest = np.maximum(longest, before["longest"])
                state = {"n_words": np.diff(found.per), "spans": [[{"first": a, "last": b} for a, b in s] for s in spans], "items": items, "longest": longest}
                made = {_PREFIX + name: pa.array(v, schema.field(_PREFIX + name).type) for name, v in state.items()}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else part.column(n) for n in schema.names], schema=schema)

    return searched


def blocks(items: DataFrame, size: int) -> Iterator[tuple[list[int], list[str]]]:
    """Benchmark items in blocks of about ``size`` bytes (an item is never cut), each as ids and texts."""
    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = known.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    if total > size:
        known = prefix_sums(known, [F.col("item_id"), F.col("text")], {"before": F.octet_length("text") + 1})
        known = settle(known.withColumn("block", F.floor(F.col("before") / size)), "benchmark-blocks")
    for i in range(-(-total // size)):
        rows = (known.where(F.col("block") == i) if total > size else known).collect()
        if rows:
            yield [r["item_id"] for r in rows], [r["text"].translate(_LOWER) for r in rows]


_LOWER = {c: c + 32 for c in range(65, 91)}


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or ``keep`` of them) with ``_hits``: struct of ``n_words, spans, items, longest``.

    ``docs`` has ``text`` (and any other columns), ``items`` has ``item_id, text``. Words are runs of digits, Latin letters
    (A-Z count as a-z) and characters beyond ASCII. A window is ``window`` consecutive words of an item, or all words of
    an item that has fewer. ``spans`` are the stretches of a document's words (first and last, from 0) that lie in an
    occurrence of any window; ``items`` the ids, rising, of the items with an occurring window; ``longest`` the words of the
    longest verbatim match of at least a window.

    Null and empty texts have no words, no hits and no windows; items without an id take no part. Items that share an
    id are one item with the windows of all; documents that share an id or repeat are searched each. A benchmark
    without items leaves all documents without hits. An empty table gives an empty table.
    """
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    state = spark.createDataFrame([], _STATE).schema
    rows = docs.select("*", *[F.lit(None).cast(f.dataType).alias(_PREFIX + f.name) for f in state])
    waiting = blocks(items, block)
    now = next(waiting, ([], []))
    while now is not None:
        then = next(waiting, None)
        schema = rows.schema if then else rows.select(*keep, *[_PREFIX + f.name for f in state]).schema
        sent = spark.sparkContext.broadcast(now)
        rows = rows.mapInArrow(_search(sent, window, to_arrow_schema(schema)), schema)
        if then:
            rows = settle(rows, "decontaminate")
            sent.destroy()
        now = then
    return rows.select(*keep, F.struct(*[F.col(_PREFIX + f.name).alias(f.name) for f in state]).alias("_hits"))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The documents, all columns, that hold no window of any benchmark item."""
    return find(docs, items, window, block).where(F.size("_hits.spans") == 0).drop("_hits")


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), keep=["doc_id"]).select("doc_id", "_hits.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda sum_, s: sum_ + s["last"] - s["first"] + 1)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)),
grams AS (
  SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT r, i, k, item_id FROM grams JOIN windows USING (k, g)),
hit AS (SELECT r, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r),
listed AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""
