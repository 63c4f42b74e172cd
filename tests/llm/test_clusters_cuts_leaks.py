"""Centroid clustering, fill-in-the-middle and decontamination against brute force, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.llm import centroids, decontaminate, fill_middle, wordscan

CLASH = ", _digest string, h1 long, form string, output string, vector string, cluster int, spans string, items string, _hits int, n_words long"


def clash(row):
    return (*row, "d", 5, "f", "o", "v", 1, "s", "i", 2, 3)


# ---- clusters


def lloyd(rows, k, rounds, scale, seed):
    """(id, vector) to clusters by the definition, in Python integers."""
    vectors = [[int(np.floor(scale * x)) for x in v] for _, v in rows]
    digest = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), np.array(v, np.int32).tobytes(), v) for (i, _), v in zip(rows, vectors, strict=True) if i is not None)
    made = [v for _, _, v in digest[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(made))

    for _ in range(rounds):
        at = [nearest(v)[1] for v in vectors]
        made = [
            [sum(col) // len(col) for col in zip(*own, strict=True)] if (own := [v for v, a in zip(vectors, at, strict=True) if a == j]) else c for j, c in enumerate(made)
        ]
    return [(i, *nearest(v)[::-1]) for (i, _), v in zip(rows, vectors, strict=True)], made


def some_vectors():
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(size=6).round(2).tolist()) for i in range(150)]
    rows += [(7, [0.25] * 6)] * 90  # a third of all rows are one vector of one id
    rows += [(None, [0.5] * 6), (200, [-0.0] * 6), (7, [0.75] * 6)]
    rows += [(300 + i, [float(i % 2)] * 6) for i in range(20)]  # equally far from what is between them
    return rows


def test_clusters_equal_brute_force_on_odd_rows(spark):
    rows = some_vectors()
    odd = [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 5 + [None]), (504, [float("nan")] + [1.0] * 5), (505, [float("inf")] * 6), (506, [1e200] + [0.0] * 5)]
    df = spark.createDataFrame([clash(r) for r in rows + odd], "vec_id long, embedding array<double>" + CLASH).repartition(5)
    members, made = centroids.clusters(df, k=5, rounds=4, size=6)
    want, means = lloyd(rows, 5, 4, 1024, "3")
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in members.where("cluster is not null").collect())
    assert got == sorted((i is None, i or 0, c, d) for i, c, d in want)
    assert [tuple(r) for r in members.where("cluster is null").select("vec_id", "distance").collect()] == [(506, None)]
    assert [list(r["centroid"]) for r in made.orderBy("cluster").collect()] == means


def test_few_or_no_vectors_give_fewer_clusters(spark):
    schema = "vec_id long, embedding array<float>"
    members, made = centroids.clusters(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], schema), size=2)
    assert sorted(r["distance"] for r in members.collect()) == [0, 0] and made.count() == 2
    for rows in ([], [(None, None)]):
        members, made = centroids.clusters(spark.createDataFrame(rows, schema), size=2)
        assert members.count() == 0 and made.count() == 0
    members, made = centroids.clusters(spark.createDataFrame([(None, [1.0, 2.0])], schema), size=2)
    assert [r["cluster"] for r in members.collect()] == [None] and made.count() == 0


def test_bounds_hold_and_filter(spark):
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(6, 64))
    x = np.floor(1024 * (rng.normal(size=(3000, 6)) @ basis + 0.05 * rng.normal(size=(3000, 64)))).astype(np.int32)
    x[:20] = x[20]
    df = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "i long, vector binary").repartition(7)
    mean, axes, leading = centroids.principal_axes(df, 64, 0.8)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(axes.T @ axes, np.eye(64)) and leading <= 6
    chosen = x[20:28].copy()
    chosen[1] = chosen[0]  # a tie
    finder = centroids.Nearest(chosen, mean, axes, leading)
    lead, rest = centroids.rotate(x.astype(float), mean, axes, leading)
    exact = np.square(x[:, None].astype(np.int64) - chosen).sum(axis=2)
    assert (finder.bounds(lead, rest) <= exact).all()
    at, distance = finder(x, lead, rest)
    assert (at == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert finder.checked < 0.5 * 8 * len(x)


def test_filter_on_the_given_table(spark):
    members, _ = centroids.clusters(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), rounds=3)
    rows, checked = members.agg(F.count(F.lit(1)), F.sum("n_checked")).first()
    assert checked < 0.35 * rows * centroids.CENTROIDS


# ---- cuts


@given(st.lists(st.text(alphabet="aZ é漢\U0001f600\n1<", max_size=30), min_size=1, max_size=6), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_ranks_and_cuts_equal_counting(texts, draw):
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    kinds = fill_middle.classes(data, bounds)
    matrix = fill_middle.WaveletMatrix(kinds)
    at = np.arange(len(data) + 1)
    for v in range(4):
        assert (matrix.rank(v, at) == [np.count_nonzero(kinds[:i] == v) for i in at]).all()
    for unit, pattern in (("token", r"[A-Za-z]+|[^A-Za-z]"), ("char", r"(?s).")):
        wanted = fill_middle.UNITS[unit]
        pieces = [re.findall(pattern, t) for t in texts]
        n = matrix.count(wanted, bounds[1:]) - matrix.count(wanted, bounds[:-1])
        assert n.tolist() == [len(p) for p in pieces]
        units = np.int64(draw) % (n + 1)
        cut = matrix.cut(wanted, bounds[:-1], bounds[1:], units)
        assert [data[a:b].tobytes().decode() for a, b in zip(bounds, cut, strict=False)] == ["".join(p[:u]) for p, u in zip(pieces, units, strict=True)]


def expected(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(m in text for m in fill_middle.MARKS) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}")
    return (doc_id, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


def test_transform_and_restore_on_odd_rows(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "a", "<", "x<S y<", "P>", "a <P> b", "<M>", "é漢\U0001f600 end", "l1\r\nl2\n\n", "\x00z", "a" * 70000 + " " + "b1" * 3000, "long words " * 50000]
    texts += ["".join(rng.choice("abC <>PSM\n é1") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id at all"), (None, None), (3, "again"), (3, "again"), (-5, "negative id")]
    df = spark.createDataFrame([clash(r) for r in rows], "doc_id long, text string" + CLASH).repartition(4)
    made = fill_middle.restore(fill_middle.transform(df)).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert sorted(r["text"] for r in made) == sorted(t or "" for _, t in rows)
    assert fill_middle.transform(df.limit(0)).count() == 0


def test_cuts_at_characters(spark):
    df = spark.createDataFrame([(i, "é漢ab \U0001f600" * 9) for i in range(40)], "doc_id long, text string")
    made = fill_middle.restore(fill_middle.transform(df, unit="char", plain_from=100)).collect()
    assert all(r["n"] == 54 and r["text"] == "é漢ab \U0001f600" * 9 for r in made)
    assert len({r["prefix_chars"] for r in made}) > 10


# ---- leaks


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for key, text in docs:
        w, hit, ids, longest = words_of(text), set(), set(), 0
        for item, t in items:
            v = words_of(t)
            if item is None or not v:
                continue
            k = min(window, len(v))
            for i in range(len(w)):
                for j in range(len(v) - k + 1):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n >= k:
                        hit |= set(range(i, i + k))
                        ids.add(item)
                        longest = max(longest, n)
        out.append((key, len(w), len(hit), sorted(ids), longest))
    return out


def found(df):
    return [(r["doc_id"], r["_hits"]["n_words"], sum(s["last"] - s["first"] + 1 for s in r["_hits"]["spans"]), r["_hits"]["items"], r["_hits"]["longest"]) for r in df.collect()]


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(4)
    for size, kinds in ((0, 3), (1, 2), (400, 2), (400, 5), (900, 40)):
        words = np.append(rng.integers(0, kinds, size), 0)
        if size > 100:
            words[50:90] = words[10:50]  # a long repeat
        order = decontaminate.suffix_array(words, np.flatnonzero(words))

        def suffix(i, words=words):
            return words[i : i + int(np.flatnonzero(words[i:] == 0)[0])].tolist()

        assert sorted(order.tolist()) == np.flatnonzero(words).tolist()
        assert [suffix(i) for i in order] == sorted(suffix(i) for i in order)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_hits_equal_brute_force_on_odd_rows(spark, block):
    rng = random.Random(11)
    few = [f"w{i}" for i in range(6)] + ["É1", "ünd"]
    text = lambda n: " ".join(rng.choice(few) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 8, 14]))) for i in range(25)] + [(3, text(9)), (None, "w1"), (70, None), (71, " .-"), (72, "zz unseen words here"), (9, "w1 w2 w3")]
    docs = [(i, text(rng.choice([0, 1, 3, 20, 60]))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "W1, w2;W3 -- É1"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (None, items[0][1]), (103, "zz UNSEEN words here"), (104, "w1 é1"), (105, text(3000))]
    docs += [(200 + i, "x " + items[4][1] + " y") for i in range(30)]
    df = spark.createDataFrame([clash(r) for r in docs], "doc_id long, text string" + CLASH).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find(df.drop("_hits"), bench, window=4, block=block)
    want = brute(docs, items, 4)
    assert sorted_rows(found(out)) == sorted_rows(want)
    clean = decontaminate.without_contaminated(df.drop("_hits"), bench, window=4, block=block)
    assert clean.columns == df.drop("_hits").columns and clean.count() == sum(not w[2] for w in want)


def test_a_stretch_before_a_short_suffix_at_the_end():
    block = decontaminate.Block(np.array([1, 2]), pa.array(["a a a a", "b"]), 4)
    found = decontaminate.Result(block, wordscan.as_bytes(pa.array(["a a a a a", "b"])))
    assert [found.spans(i) for i in range(2)] == [[(0, 4)], [(0, 0)]]
    assert found.longest.tolist() == [4, 1] and [x.tolist() for x in found.items] == [[1], [2]]


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert sorted_rows(found(decontaminate.find(docs, none))) == [(1, 2, 0, [], 0), (2, 0, 0, [], 0)]
    bench = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert decontaminate.find(docs.limit(0), bench).count() == 0
    assert decontaminate.without_contaminated(docs, bench).collect()[0]["doc_id"] == 2


def test_words_that_share_a_hash_only_are_no_match():
    block = decontaminate.Block(np.array([1]), pa.array(["same other long"]), 2)
    words = wordscan.scan(wordscan.as_bytes(pa.array(["same else long"])), decontaminate.WORD)
    numbers = block.numbers(words)
    swapped = numbers.copy()
    swapped[1] = numbers[2]  # as if "else" had the hash of "long": same length, other bytes
    assert (decontaminate._verified(block, words, numbers) == numbers).all()
    assert decontaminate._verified(block, words, swapped).tolist() == [numbers[0], 0, numbers[2]]
