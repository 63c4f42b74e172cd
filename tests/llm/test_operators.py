"""Operators of the training-data pipeline against brute force, and on nulls, empty tables, ties and clashing columns."""

import random
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm import components, embedding_dedup, html_blocks, html_crf, linededup, minhash, mixing, prefix, quality, sharding, topk, toxicity, wordscan

import pyarrow as pa

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators could use for themselves, beside those of documents.
CLASH = ", _row string, _key string, size long, score double, component_id long, node long, word string, label int"
WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_docs(spark, extra=True):
    """Null, empty and very long texts, repeated rows, shared ids, null ids and sources."""
    rng = random.Random(4)
    base = prose(rng, 60)
    long = "\n".join(prose(rng, 40) for _ in range(4000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "b", 4), (4, base, "en", "b", None), (4, base, "en", "b", None),
        (5, base + " tail", "en", None, 5), (6, long, "en", "a", 6), (None, base, "en", "a", 7), (None, None, None, None, None), (7, "one two", "en", "c", 8),
        (8, "one two", "en", "c", 8), (9, "É x y \U0001f600" + "z" * 5000, "fr", "c", 9), (7, "one other", "en", "c", 8), (10, base + "\n" + base, "en", "a", 3),
    ]
    schema = DOCS
    if extra:
        rows = [(*r, "r", "k", 1, 0.5, 2, 3, "w", 1) for r in rows]
        schema += CLASH
    return spark.createDataFrame(rows, schema).coalesce(2)


def some_labels(spark, docs=200):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(docs)] + [(None, 1, True), (5, None, None)], "doc_id long, quality int, toxic_ boolean").select(
        "doc_id", "quality", F.col("toxic_").cast("int").alias("toxic")
    )


@pytest.fixture(scope="module")
def odd(spark):
    return odd_docs(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + CLASH)


# ---- helpers


def test_prefix_sums_with_a_hot_key_and_ties(spark):
    rng = random.Random(2)
    rows = [(7 if i % 3 else rng.randint(0, 50), i, rng.choice([None, 0, 1, 5])) for i in range(900)]
    got = prefix.prefix_sums(spark.createDataFrame(rows, "k int, i int, v int").repartition(5), [F.col("k"), F.col("i")], {"s": F.col("v")}).collect()
    total, want = 0, {}
    for k, i, v in sorted(rows, key=lambda r: r[:2]):
        want[i] = total
        total += v or 0
    assert {r["i"]: r["s"] for r in got} == want


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5000, 5300)] + [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)]
    edges += [(3, 3), (3, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_positions_and_hashes():
    texts = ["Ab  c\td\n", None, "", "x", " é Éa " + "q" * 3000, "ab"]
    column = wordscan.as_bytes(pa.array(texts, pa.string()))
    for part in (column, column.slice(1), column.slice(3, 2)):
        found = wordscan.scan(part, ~wordscan.SPACE)
        raw = bytes(found.data)
        words = [(int(d), raw[a:b]) for d, a, b in zip(found.doc, found.start, found.end, strict=True)]
        want = [(i, w) for i, t in enumerate(part.to_pylist()) for w in (t or b"").lower().split()]
        assert words == want
        (h,) = found.hashes()
        assert len({(w, int(x)) for (_, w), x in zip(words, h, strict=True)}) == len({w for _, w in words})
    assert list(wordscan.slices(column, 4)) == [(0, 1), (1, 3), (3, 4), (4, 5), (5, 6)] or [r for r in wordscan.slices(column, 4)][-1][1] == 6


# ---- embeddings


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        base = rng.normal(size=16)
        rows.append((i, base.tolist(), i % 3))
        if i % 4 == 0:
            rows.append((1000 + i, (base + rng.normal(size=16) * 0.02).tolist(), i % 3))
            rows.append((2000 + i, base.tolist(), i % 3))
            rows.append((3000 + i, base.tolist(), 7))
    hub = rng.normal(size=16)
    rows += [(5000 + i, (hub + rng.normal(size=16) * 0.01).tolist(), 1) for i in range(300)]
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * 16, 1), (6003, [float("nan")] * 16, 1), (6004, [None] + [1.0] * 15, 1), (6005, hub.tolist(), None), (6006, [1.0, 2.0], 1), (None, hub.tolist(), 1)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string").repartition(3)


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


def test_embedding_links_are_exact(spark):
    rows, df = vectors(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    links = {r[0]: [] for r in rows}
    good = [(i, np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if usable(v) and any(v) and y is not None and i is not None]
    for a, (i, v, y) in enumerate(good):
        for j, w, z in good[:a]:
            if y == z and len(v) == len(w) and v @ w >= 0.98:
                links[i].append(j)
                links[j].append(i)
    for i, own in links.items():
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = None if i is None else min(seen)
        assert got[i] == (len(own), least, True if i is None else least == i)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pairs_in_a_crowd_are_found(spark):
    rng = np.random.default_rng(2)
    n, pairs, size = 8000, 300, 64
    centre = np.eye(size)[0]
    spread = rng.normal(size=(n, size)) * (1 - centre)
    crowd = np.sqrt(0.95) * centre + np.sqrt(0.05) * spread / np.linalg.norm(spread, axis=1)[:, None]
    for i in range(pairs):  # a partner at cosine 0.981
        off = rng.normal(size=size)
        off -= off @ crowd[2 * i] * crowd[2 * i]
        crowd[2 * i + 1] = 0.981 * crowd[2 * i] + np.sqrt(1 - 0.981**2) * off / np.linalg.norm(off)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(crowd)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(pairs)) >= 0.995 * pairs


@pytest.mark.parametrize("partitions", [3, 200])
def test_windows_reach_across_partitions(spark, partitions):
    """Links are those of one walk over all rows, also where partitions hold less than a window."""
    rng = np.random.default_rng(4)
    n = 3000
    base = rng.normal(size=(600, 8))
    vectors = base[rng.integers(0, 600, n)] + rng.normal(scale=0.03, size=(n, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [("a" if i < 2000 else "b", i // 2, i, vectors[i].tobytes()) for i in range(n)]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(max(0, i - embedding_dedup.WINDOW), i):
            if rows[i][0] == rows[j][0] and vectors[i] @ vectors[j] >= embedding_dedup.COSINE:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        walked = embedding_dedup.walk(spark.createDataFrame(rows, "group string, code long, node long, unit binary"))
        assert walked.where("part is not null").select("part").distinct().count() >= partitions / 2
        inside = {(r["a"], r["b"]) for r in walked.where("part is null").select("a", "b").collect()}
        links = inside | {(r["a"], r["b"]) for r in embedding_dedup.across(walked).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = list(range(n))

    def home(x):
        while got[x] != x:
            x = got[x]
        return x

    for x, y in links:
        a, b = sorted((home(x), home(y)))
        got[b] = a
    assert [home(i) for i in range(n)] == [root(i) for i in range(n)]


def test_top_k_is_exact(spark):
    rows, df = vectors(spark)
    df = df.unionByName(df.where("vec_id = 50"))
    got = {}
    for r in topk.top_k(df, every=25).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = [(i, np.floor(256 * np.array(v))) for i, v, _ in rows if i is not None and usable(v)]
    want = {}
    for i, v in whole:
        if i % 25 == 0:
            scored = sorted((-int(v @ w), j) for j, w in whole if j != i and len(v) == len(w))
            want[i] = [(j, -s) for s, j in scored[:5]]
    assert got == {k: v for k, v in want.items() if v}
    assert topk.top_k(df.limit(0)).count() == 0


def test_lists_keep_ties_and_exactness():
    rng = np.random.default_rng(3)
    vectors_ = np.floor(rng.normal(size=(4000, 12)) * 40)
    vectors_[100:120] = vectors_[3]
    ids = rng.permutation(4000)
    lists = topk.Lists(ids, vectors_)
    for q in (3, 7, 9):
        want = sorted((-int(vectors_[q] @ w), int(i)) for i, w in zip(ids, vectors_, strict=True) if i != ids[q])[:5]
        assert lists.best(int(ids[q]), vectors_[q], 5) == [(i, -s) for s, i in want]
    assert topk.Lists(ids[:3], vectors_[:3]).best(-1, vectors_[5], 5) == [(i, s) for s, i in sorted(((int(vectors_[5] @ w), int(i)) for i, w in zip(ids[:3], vectors_, strict=False)), key=lambda x: (-x[0], x[1]))]


def test_bounds_stop_the_reading_on_the_given_table(spark):
    """At most one in twenty vectors is left before the last eighth of the lists, and dropped ones are read no more."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    vectors_ = np.floor(256 * np.array([r["embedding"] for r in rows], float))
    ids = np.array([r["vec_id"] for r in rows])
    lists = topk.Lists(ids, vectors_)
    asked = np.flatnonzero(ids % 50 == 0)
    left, reads = [], []
    for q in asked:
        before = lists.read
        got = lists.best(int(ids[q]), vectors_[q], 5)
        scores = vectors_ @ vectors_[q]
        scores[q] = -np.inf
        assert [s for _, s in got] == sorted(scores, reverse=True)[:5]
        left.append(max(share for read, share in lists.left if read >= 7 / 8))
        reads.append((lists.read - before) / vectors_.size)
        after = [share for _, share in lists.left]
        assert after == sorted(after, reverse=True)
        # each list is read for the vectors left when it was begun, at most
        assert lists.read - before <= sum(round(share * len(ids)) for share in [1 - 1 / len(ids), *after[:-1]])
    assert np.mean(left) <= 0.05 and np.mean(reads) < 0.9


def test_huge_components_have_defined_scores(spark):
    rows = [(0, [1e200, 1.0]), (50, [1.0, 2.0]), (1, [-1e200, 0.5]), (2, [1e305, 1.0]), (3, [1e307, 1.0]), (4, [2.0**40, 1.0]), (5, [3.0, 3.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    top, unit = 2**63 - 1, 256
    assert got[50][:4] == [(0, top), (2, top), (4, unit * unit * 2**40 + 2 * unit * unit), (5, unit * unit * 9)]
    assert got[50][4:] == [(1, -(2**63))]  # the multiple of 1e307 is not finite: it takes no part
    assert [i for i, _ in got[0]] == [2, 4, 5, 50, 1]


def test_tiny_sources_are_mixed_up_to_three_times(spark):
    rng = random.Random(12)
    rows = [(i, "big", prose(rng, 40)) for i in range(60)] + [(100, "t5", prose(rng, 5)), (101, "t7", prose(rng, 3)), (102, "t7", prose(rng, 4)), (103, "u0", None), (104, "z1", "one")]
    got = mixing.mix_words(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["target"], []).append(r)
        assert r["taken"] <= 3 * r["size"]
    taken = {}
    for r, (_, source, _) in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        taken[source] = taken.get(source, 0) + r["taken"]
    assert (taken["t5"], taken["t7"], taken["u0"], taken["z1"]) == (15, 21, 0, 3)


# ---- near duplicates


def shingle_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def brute_groups(rows, limit):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and Fraction(len(s & t), len(s | t)) >= limit:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def near_rows(seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words = prose(rng, rng.randint(3, 90)).split()
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            other = list(words)
            other[rng.randrange(len(other))] = "changed"
            rows.append((100 + i, " ".join(other).upper()))
        if i % 10 == 0:
            rows.append((200 + i, "\t".join(words)))
    base = prose(rng, 120).split()
    for i in range(80):  # a large bucket
        other = list(base)
        other[i] = f"x{i}"
        rows.append((1000 + i, " ".join(other)))
    return rows


@pytest.mark.parametrize("limit", [Fraction(4, 5), Fraction(85, 100)])
def test_minhash_groups_match_brute_force(spark, limit):
    rows = near_rows()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), limit).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_groups(rows, limit)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingle_set(t)) for i, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    groups = brute_groups([r for r in rows if r[0] != 7], Fraction(4, 5))
    assert all(r["component_id"] == groups[r["doc_id"]] for r in got if r["doc_id"] in groups and r["doc_id"] != 8)
    assert all(r["kept"] for r in got if r["doc_id"] is None or r["n_shingles"] == 0)
    left = minhash.without_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 4, 6, 7, 7, 9]
    assert minhash.without_near_duplicates(empty).count() == 0


# ---- lines


def brute_lines(rows, least, short=linededup.SHORT_WORDS):
    """A line goes if it lies in a stretch of at least ``least`` words, or has ``short`` by itself, that an earlier place has too."""

    def key(i, t):
        value = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return (-1 if i is None else i, value - (1 << 64 if value >> 63 else 0))

    docs = sorted({(0, key(i, t), t) for i, t in rows if t is not None})
    places = [(d, [(n, s) for n, line in enumerate(t.split("\n")) if (s := line.strip(" \t\n\x0b\f\r"))]) for d, (_, _, t) in enumerate(docs)]
    seen, gone = set(), set()
    grams = []
    for d, lines in places:
        for a in range(len(lines)):
            for way in ("ahead", "back"):
                words, part = 0, []
                for n, s in lines[a:] if way == "ahead" else lines[a::-1]:
                    part.append((n, s))
                    words += len(s.split())
                    if words >= least:
                        part.sort()
                        grams.append(((d, part[0][0]), way, tuple(s for _, s in part), [n for n, _ in part]))
                        break
        grams += [((d, n), "line", (s,), [n]) for n, s in lines if short is not None and short <= len(s.split()) < least]
    for (d, _), way, content, numbers in sorted(grams, key=lambda g: g[0]):
        if (way, content) in seen:
            gone.update((d, n) for n in range(numbers[0], numbers[-1] + 1))
        seen.add((way, content))
    out = {}
    for d, (_, k, t) in enumerate(docs):
        out[k] = "\n".join(line for n, line in enumerate(t.split("\n")) if (d, n) not in gone)
    return [(i, None if t is None else out[key(i, t)]) for i, t in rows]


def test_line_runs_match_brute_force(spark):
    rng = random.Random(8)
    lines = [prose(rng, rng.choice([1, 2, 3, 6, 12])) for _ in range(40)]
    rows = []
    for i in range(80):
        own = [rng.choice(lines) if rng.random() < 0.5 else prose(rng, rng.randint(1, 8)) for _ in range(rng.randint(0, 14))]
        if i % 4 == 0:
            at = rng.randrange(35)
            own[2:2] = lines[at : at + rng.randint(1, 5)]
        rows.append((i, "\n".join(own) if i % 5 else "\n  \n".join(own)))
    got = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(brute_lines(rows, linededup.MIN_WORDS))
    assert sum(a[1] != b[1] for a, b in zip(rows, brute_lines(rows, linededup.MIN_WORDS), strict=True)) > 20


def test_line_dedup_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = linededup.drop_repeated_lines(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, brute_lines(rows, linededup.MIN_WORDS)))
    assert linededup.drop_repeated_lines(empty).count() == 0


def test_only_long_runs_without_short_words(spark):
    rows = [(i, "five words make this line\nown line " + "x" * i) for i in range(4)]
    got = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), short_words=None).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == brute_lines(rows, linededup.MIN_WORDS, None) == rows


def test_long_passage_stays_once(spark):
    passage = prose(random.Random(1), 60)
    rows = [(i, f"own {i}\n{passage}\nend {i}") for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own {i}\nend {i}" for i in range(1, 5))


def test_hot_short_lines_stay_once(spark):
    rng = random.Random(3)
    hot = "Subscribe to our free letter now"
    rows = [(i, "\n".join([hot, prose(rng, 12), "Les.", hot, prose(rng, 4)])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in linededup.drop_repeated_lines(docs, short_words=linededup.SHORT_WORDS).collect()}
    for i, text in rows:
        lines = text.split("\n")
        assert got[i] == [x for n, x in enumerate(lines) if x != hot or (i, n) == (0, 0)]
    staged = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert sum(r["text"].split("\n").count(hot) for r in staged.collect()) == 1


# ---- shards and mixing


def test_shards_are_even_and_keep_texts_together(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(2000)] + [(5000 + i, "the same text") for i in range(700)] + [(9000 + i, None if i % 2 else "") for i in range(700)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    shards, homes = {}, {}
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        shards.setdefault(r["shard"], []).append(r)
        homes.setdefault(raw, set()).add(r["shard"])
    assert sorted(shards) == list(range(16))
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in shards.values())
    sizes = [sum(r["size"] for r in own) for own in shards.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    assert all(len(s) == 1 for s in homes.values())


def test_shards_of_odd_rows(spark, odd, empty):
    got = sharding.shard_by_bytes(odd).collect()
    assert len(got) == odd.count()
    assert sharding.shard_by_bytes(empty).count() == 0
    one = spark.createDataFrame([(i, "all alike, but too many for a shard") for i in range(320)], "doc_id long, text string")
    sizes = [r["count"] for r in sharding.shard_by_bytes(one).groupBy("shard").count().collect()]
    assert sizes == [20] * 16


def highest_quotients(targets, fit, seats):
    taken = {s: 0 for s in targets}
    for _ in range(seats):
        open_ = [(-(targets[s] / (2 * taken[s] + 1)), s) for s in targets if taken[s] < fit[s] and targets[s] > 0]
        if not open_:
            break
        taken[min(open_)[1]] += 1
    return taken


def test_quotas_are_sainte_lague(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 3, 50, 700, 9000])) for i in range(40)]
    sources = mixing.targets(spark.createDataFrame(rows, "source long, source_size long"))
    got = sources.collect()
    target, size = {r["nth"]: r["target"] for r in got}, {r["nth"]: r["source_size"] for r in got}
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 and all(target[s] <= 3 * size[s] + 1e-9 for s in target)
    loose = {r["nth"]: r["target"] / r["weight"] for r in got if r["target"] < 3 * r["source_size"]}
    assert max(loose.values()) - min(loose.values()) < 1e-6
    assert all(r["target"] / r["weight"] <= max(loose.values()) + 1e-6 for r in got)
    fit = {s: 3 * size[s] // 16 for s in size}
    blocks = int(sum(target.values()) / 16 + 0.5)
    quota = {}
    for r in mixing.apportion(sources).collect():
        quota.setdefault(r["shard"], {})[r["nth"]] = r["quota"]
    total = {s: 0 for s in target}
    for shard in range(1, 9):
        for s in target:
            assert quota[shard][s] >= 0
            total[s] += quota[shard][s]
        assert total == highest_quotients(target, fit, blocks * shard // 8)


def test_mix_follows_targets(spark, odd, empty):
    rng = random.Random(7)
    rows = [(i, None if i % 50 == 0 else prose(rng, rng.randint(0, 80)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_words(df).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_words(df.repartition(3)).collect()))
    by, home = {}, {i: s for i, _, s in rows}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        own = by.setdefault(home[r["doc_id"]], [0, 0, r["source_size"], r["target"]])
        own[0] += r["taken"]
        own[1] += r["size"]
    assert all(abs(target - taken) <= 16 and size == source_size for taken, size, source_size, target in by.values())
    words = {i: len((t or "").split()) for i, t, _ in rows}
    mixed = mixing.mix_documents(df).groupBy("source").agg(F.collect_list("doc_id").alias("ids")).collect()
    source_size, target = {}, {}
    for r in got:
        source_size[r["doc_id"]], target[r["doc_id"]] = r["source_size"], r["target"]
    for r in mixed:
        assert abs(sum(words[i] for i in r["ids"]) - target[r["ids"][0]]) <= 16 + 2 * 80
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix_words(odd).count() == odd.count()
    assert mixing.mix_words(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


# ---- classifiers


def test_segments_are_all_maximal():
    rng = np.random.default_rng(5)

    def brute(scores, lo, hi):
        best = max(((scores[a:b].sum(), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, a, b = best
        return [*brute(scores, lo, a), (float(scores[a:b].sum()), a, b - 1), *brute(scores, b, hi)]

    for _ in range(60):
        scores = rng.normal(-0.3, 1, rng.integers(0, 22))
        assert [(round(s, 9), a, b) for s, a, b in toxicity.segments(scores)] == [(round(s, 9), a, b) for s, a, b in brute(scores, 0, len(scores))]


def labelled_docs(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(700):
        toxic, bad = i % 5 == 0, i % 4 == 0
        words = prose(rng, rng.randint(20, 90)).split()
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "vile" + rng.choice(["en", "st", "ly", "o"]))
        text = " ".join(w + "%%" if bad and rng.random() < 0.7 else w for w in words)
        rows.append((i, text, "en", "a", 1))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_classifiers_on_held_out_rows(spark, kind, odd, empty):
    docs, labels, truth = labelled_docs(spark)
    module, column = (toxicity, 2) if kind == "toxicity" else (quality, 1)
    model = module.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    held = [t for t in truth if zlib.crc32(str(t[0]).encode()) % module.PARTS == module.FOLD]
    right = sum((got[t[0]] >= 0.3) == bool(t[column]) for t in held)
    assert len(held) > 80 and right / len(held) > 0.95
    rows = module.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(empty, model).count() == 0
    for no_labels in (labels.limit(0), labels.withColumn(kind if kind == "quality" else "toxic", F.lit(0))):
        assert all(r["score"] == (0.5 if kind == "quality" and no_labels.isEmpty() else 0.0) for r in module.score(docs, module.train(docs, no_labels)).collect())
    assert module.score(docs, module.train(empty, labels)).count() == 700


def test_toxic_passages_and_filter(spark, odd):
    docs, labels, truth = labelled_docs(spark)
    model = toxicity.train(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, model).where("n_passages > 0").collect():
        for p in r["passages"]:
            assert "vile" in text[r["doc_id"]].encode()[p["start"] : p["end"]].decode() or p["chance"] > 0.01
    left = {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()}
    assert sum(t[0] in left for t in truth if t[2]) <= 4 and sum(t[0] not in left for t in truth if not t[2]) <= 4
    assert toxicity.without_toxic(odd, labels).columns == odd.columns


def test_a_passage_counts_wherever_it_stands(spark):
    docs, labels, _ = labelled_docs(spark)
    model = toxicity.train(docs, labels)
    rng = random.Random(7)
    bad, clean = "vileen vilest vilely vileo", prose(rng, 4000)
    texts = [f"{bad} {clean} {bad}", f"{bad} {clean}", f"vileen {prose(rng, 400)} vilest {prose(rng, 400)} vilely {prose(rng, 400)} vileo {prose(rng, 400)} {bad}", " ".join(["vileen"] * 40)]
    got = toxicity.Judge(model).read(pa.array(texts))[1]
    begin = [p["start"] for p in got[0]]
    assert begin[0] == 0 and begin[-1] == texts[0].rindex(bad) and len(begin) == len(got[1]) + 1
    assert got[0][0]["chance"] == pytest.approx(got[0][-1]["chance"])
    assert texts[2].rindex(bad) in [p["start"] for p in got[2]]
    assert len(got[3]) <= 1  # one word said often is one word's evidence


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    machine = quality.Machine(np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES)))
    machine.w = rng.normal(size=len(machine.w)).astype(np.float32)
    machine.v = rng.normal(size=machine.v.shape).astype(np.float32)
    machine.bias = 0.25
    feature, x = np.array([3, 9, 700, 8200, 5, 9]), rng.normal(size=6).astype(np.float32)
    got = machine.margin(np.array([0, 4, 6]), feature, x)[0]
    for (a, b), g in zip([(0, 4), (4, 6)], got, strict=True):
        f, v = feature[a:b], x[a:b]
        pairs = sum(machine.v[f[i]] @ machine.v[f[j]] * v[i] * v[j] for i in range(b - a) for j in range(i))
        assert abs(g - (0.25 + machine.w[f] @ v + pairs)) < 1e-3


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<header class="site-header"><div class="logo">Brand</div><nav><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies. Accept?</p><button>Accept</button></div>
<article><h1>The  title &amp; more</h1><p><b>First line of the text,&nbsp;with a reference &#233; and marks.<br><p>Second <a href="x">line</a> of the text
 goes on over two lines, and ends here.</p><div class="ad">Buy this now</div><script>var x = "</p>";</script>
<p>Third part of the text, long enough to be read as such.</p></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I think this is a comment, and not a short one at that.</p></div></section>
<aside class="sidebar"><ul><li><a href="#">Related</a></li></ul></aside>
<form class="newsletter"><label>Email</label><input><button>Go</button></form>
<footer>&copy; Brand &middot; All rights reserved.</footer></body></html>"""


def test_page_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p", "x"), (5, "u", PAGE * 40, "x"), (5, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    field = html_crf.train(pages)
    got = html_crf.extract(pages, field).collect()
    want = "The title & more\nFirst line of the text, with a reference é and marks.\nSecond line of the text goes on over two lines, and ends here.\nThird part of the text, long enough to be read as such."
    texts = sorted((r["text"] for r in got), key=len)
    assert texts[:5] == ["", "", "", want, want]
    assert texts[5].count("The title & more") == 40 and "cookies" not in texts[5]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_crf.extract(pages.limit(0), html_crf.train(pages.limit(0))).count() == 0


def test_layouts_held_out_and_viterbi():
    rng = random.Random(2)
    passages = [prose(rng, rng.randint(5, 60)) + "." for _ in range(200)]
    pages, labels = html_crf.layouts(passages, 200, seed=1)
    seen = sorted({n for p in pages for f in html_crf.describe(p) for n in f})
    field = html_crf.Field(seen)
    field.fit([list(html_crf.describe(p)) for p in pages], labels, rounds=80)
    others, truth = html_crf.layouts(passages, 80, seed=2)
    right = sum(a == b for p, y in zip(others, truth, strict=True) for a, b in zip(field.decode(p), y, strict=True))
    assert right / sum(map(len, truth)) > 0.98
    page = others[0][:9]
    score = field.scores(page)
    best = max(
        (tuple((m >> i) & 1 for i in range(len(page))) for m in range(1 << len(page))),
        key=lambda y: sum(score[i, v] for i, v in enumerate(y)) + sum(field.transition[a, b] for a, b in zip(y, y[1:], strict=False)),
    )
    assert field.decode(page) == list(best)


@pytest.mark.parametrize("page", ["<div class='nav x'>t " * 20_000, "".join(f"<e{i}>t " for i in range(20_000)), "<div>t " * 10_000 + "</section>t </div>" * 10_000])
def test_deep_pages_take_memory_in_proportion(page):
    tracemalloc.start()
    found = html_blocks.blocks(page)
    seen = sum(len(names) for names in html_crf.describe(found, frozenset(["div"])))
    own = html_crf.own_labels(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) >= 20_000 and seen < 16 * len(found) and own is None
    assert peak < 60e6


def test_descriptions_follow_the_path_of_each_block():
    rng = random.Random(5)
    kinds = "div p li article main nav section header aside".split()
    for _ in range(200):
        page = "".join(rng.choice([f"<{k}>", f"</{k}>", f'<{k} class="nav story">', "t. "]) for k in rng.choices(kinds, k=40))
        found = html_blocks.blocks(page)
        labels = html_crf.own_labels(found)
        some = False
        for n, (block, names) in enumerate(zip(found, html_crf.describe(found), strict=True)):
            path, at = [], block.inmost
            while at is not None:
                path.insert(0, at)
                at = at.parent
            assert {x for x in names if x.startswith("in ")} - {"in no article"} == {f"in {e.tag}" for e in path}
            assert ("named nav" in names) == any("nav" in e.words for e in path)
            first = next((i for i, e in enumerate(path) if e.tag in ("article", "main")), None)
            some = some or first is not None
            if labels is not None:
                main = first is not None and not any(e.tag in html_crf.ASIDE_TAGS or e.tag == "header" for e in path[:first])
                main = main and not any(e.tag not in ("article", "main") and (e.tag in html_crf.ASIDE_TAGS or set(e.words) & html_crf.NAMED_ASIDE) for e in path[first:])
                assert labels[n] == int(main)
        assert (labels is not None) == some


@pytest.mark.parametrize("page", ["", "<", "a < b", "<p", "<p class='x", "<!-- open", "<script>never closed", "</div></p>x", "<p>a<p>b", "&amp", "&am", "<a href='x>y'>t</a>", "<li>a<li>b" * 300, "<div>" * 3000 + "x"])
def test_any_page_parses(page):
    assert all(b.text == " ".join(b.text.split()) for b in html_blocks.blocks(page))


@pytest.mark.parametrize(
    "page, want",
    [
        ('<header><svg class="i"/></header><article><p>Main one.</p></article>', ["Main one."]),
        ("<article><title-bar>x</title-bar><p>Main.</p></article>", ["x", "Main."]),
        ("<article><template-row>a</template-row><object-list>b</object-list></article>", ["a", "b"]),
        ("<div><select><option>a<option>b</div><p>Main.</p>", ["Main."]),
        ("<p><span><object data=x></span> Main.</p><div><noscript><p>No</div><p>Two.</p>", ["Main.", "Two."]),
        ("<p>Area <math><mi>a</mi><mo>=</mo><mn>2</mn></math> is <svg><title/><g><text>no</g></svg>two.</p>", ["Area a=2 is two."]),
        ("<object><object>no</object>no</object><p>Main.<script>a</p></SCRIPT > End.</p><style>no", ["Main. End."]),
    ],
)
def test_only_what_is_unseen_goes(page, want):
    assert [b.text for b in html_blocks.blocks(page)] == want
