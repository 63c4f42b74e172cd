"""History jobs: text readers, reachability and merge ranges against plain graph walks, author shares."""

import random
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from codequarry.operators import branches as br
from codequarry.operators import chains
from codequarry.operators import history
from codequarry.plans.codebase import Codebase
from codequarry.sources import files as src
from codequarry.sources import history_text as ht
from codequarry.sources import store

COMMITS = "repo string, repo_ord int, hash string, author string, ts bigint, subject string, message string, log_seq bigint, parents array<string>"


def random_history(seed: int, n: int, repo: str):
    """A random topologically ordered history; log_seq lists children first."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        earlier = list(range(max(0, i - 6), i))
        rng.shuffle(earlier)
        parents = [f"{repo}{p}" for p in earlier[: rng.choice((1, 1, 1, 2, 3))]]
        rows.append((repo, 0, f"{repo}{i}", f"a{i % 3}", 1000 + 50 * i, f"s{i}", f"s{i}", n - i, parents))
    return rows


def ancestors(parents: dict, tip: str) -> set:
    seen, todo = set(), [tip]
    while todo:
        h = todo.pop()
        if h not in seen:
            seen.add(h)
            todo.extend(parents[h])
    return seen


@pytest.fixture(scope="module")
def dag(spark, tmp_path_factory):
    rows = random_history(3, 60, "x") + random_history(4, 35, "y")
    path = str(tmp_path_factory.mktemp("dag") / "t")
    spark.createDataFrame(rows, COMMITS).coalesce(2).write.parquet(path)
    return spark.read.parquet(path), {r[2]: r[8] for r in rows}


def test_reachable(spark, dag):
    commits, parents = dag
    tips = spark.createDataFrame([("x", "x55"), ("y", "y34")], "repo string, hash string")
    got = {r["hash"] for r in br.reachable(commits, tips).collect()}
    assert got == ancestors(parents, "x55") | ancestors(parents, "y34")


def _exchanges(df):
    """Each exchange of a plan with the line of what feeds it."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [f"{line} <- {below}" for line, below in zip(plan, plan[1:]) if " Exchange " in line]


@pytest.mark.parametrize("block_rows", [7, 65_536])
def test_rollback_rate_shuffles_numbers(spark, tmp_path, monkeypatch, block_rows):
    """Hashes are looked up once and messages stay where they are, whatever the blocks; unknown parents, two roots, a repository without a tip."""
    rows = random_history(5, 70, "x") + random_history(6, 40, "y") + random_history(7, 9, "z")
    says = ("Revert a", "plain", "roll back", "x\nROLLBACK of b", None)
    rows = [(*r[:6], says[i % 5], r[7], ["gone"] * (i % 10 == 4) + r[8]) for i, r in enumerate(rows)]
    spark.createDataFrame(rows, COMMITS).repartition(3).write.parquet(str(tmp_path / "t"))
    commits = spark.read.parquet(str(tmp_path / "t"))
    heads = spark.createDataFrame([("x", "main", "x66"), ("y", "develop", "y39"), ("y", "master", "y31"), ("z", "develop", "z8")], "repo string, name string, tip string")
    by_hash = []

    def settle(df, label, settle=chains.settle):
        by_hash.extend(label for line in _exchanges(df) if "hash#" in line.split("<-")[0])
        assert not any("message#" in line for line in _exchanges(df))
        return settle(df, label)

    monkeypatch.setattr(chains, "settle", settle)
    monkeypatch.setattr(br, "settle", settle)
    with store.setting(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        main = br.main_numbers(commits, heads, chains.chain_index(commits, block_rows))
        rate = br.rollback_rate(commits, main)
        shuffled = _exchanges(main) + _exchanges(rate)
        got = rate.collect()
    assert set(by_hash) == {"chain-parents", "tip-numbers"}
    assert shuffled and not any("hash#" in line or "message#" in line for line in shuffled)
    parents = {r[2]: [p for p in r[8] if p != "gone"] for r in rows}
    want = ancestors(parents, "x66") | ancestors(parents, "y31")
    assert {(r["repo"], r["log_seq"]) for r in main.collect()} == {(r[0], r[7]) for r in rows if r[2] in want}
    said = sum(r[2] in want and r[6] in (says[0], says[3]) for r in rows)
    assert [tuple(r) for r in got] == [(said, len(want), round(100 * said / len(want), 1))]


@pytest.mark.parametrize("block_rows", [7, 65_536])
def test_chains_are_paths_of_first_parents(dag, block_rows):
    """A chain is named by its newest commit; along it each commit is the first parent of the one before."""
    commits, parents = dag
    rows = {r["hash"]: r for r in commits.collect()}
    least = {}  # by definition: the newest commit from which first parents lead here
    for h in sorted(rows, key=lambda h: rows[h]["log_seq"]):
        least[h] = min(least.get(h, rows[h]["log_seq"]), rows[h]["log_seq"])
        for p in parents[h][:1]:
            least[p] = min(least.get(p, least[h]), least[h])
    got = chains.chain_members(commits, block_rows).collect()
    assert {r["hash"]: r["chain"] for r in got} == least
    assert all(r["tail"] == max(rows[h]["log_seq"] for h in least if least[h] == r["chain"] and h[0] == r["repo"]) for r in got)


def test_long_branches_take_few_rounds(spark, monkeypatch):
    """A branch of 2,000 commits that took main in 20 times, and main's merge of it."""
    rows, n, side = [], 0, None
    main, tips = [], {}

    def commit(parents):
        nonlocal n
        n += 1
        rows.append(("r", f"c{n}", n, 100_000 - n, parents))
        return f"c{n}"

    main.append(commit([]))
    for i in range(2000):
        if i % 4 == 0:
            main.append(commit([main[-1]]))
        side = commit([side or main[0]] + ([main[-1]] if i % 100 == 99 else []))
    tips["merge"] = commit([main[-1], side])
    parents = {r[1]: r[4] for r in rows}
    commits = spark.createDataFrame(rows, "repo string, hash string, ts long, log_seq long, parents array<string>").repartition(3)
    rounds = []
    monkeypatch.setattr(chains, "settle", lambda df, label, settle=chains.settle: rounds.append(label) or settle(df, label))
    merges = br.newest_merges(commits)
    got = {}
    for r in br.merge_commit_ranges(commits, merges, chains.chain_index(commits, 300)).collect():
        got.setdefault(r["merge"], set()).add(r["hash"])
    assert rounds.count("merge-walk") <= 40 and rounds.count("chain-step") <= 5
    want = {h: ancestors(parents, p[1]) - ancestors(parents, p[0]) for h, p in parents.items() if len(p) > 1}
    assert len(want) == 21 and got == want and len(got[tips["merge"]]) == 2000


def test_merge_ranges(dag):
    commits, parents = dag
    merges = br.newest_merges(commits)
    assert br.newest_merges(commits, 5).count() == 10  # an option, for each repository
    got = {}
    for r in br.merge_commit_ranges(commits, merges).collect():
        assert r["hash"] not in got.setdefault(r["merge"], set())
        got[r["merge"]].add(r["hash"])
    want = {}
    for h, ps in parents.items():
        if len(ps) >= 2 and (side := ancestors(parents, ps[1]) - ancestors(parents, ps[0])):
            want[h] = side
    assert want and got == want


def test_blame_reader(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for f in range(40):
        seen, seq, path = set(), 0, f"f{f}"
        for no in range(1, rng.randint(2, 30)):
            commit = f"{rng.randint(0, 5):040x}"
            out = [f"{commit} {no} {no}"]
            if commit not in seen:
                out += [f"author by {commit[-1]}", "author-mail <x>"]
                seen.add(commit)
            out.append("\tcode " + rng.choice(("author x", "y", "")))
            for t in out:
                seq += 1
                rows.append(("r", path, seq, t))
            want[path, no] = f"by {commit[-1]}"
    dump = spark.createDataFrame(rows, "repo string, path string, seq bigint, text string")
    for chunk in (None, 7):
        got = {(r["path"], r["line_no"]): r["author"] for r in ht.ingest_blame(dump, chunk).collect()}
        assert got == want


def test_log_files(spark, tmp_path):
    (tmp_path / "log").write_text("__COMMIT__\nAnn\n100\nfix: a\n\na.go\nb.go\n__COMMIT__\nBob \n200\nmerge\n__COMMIT__\nbroken\n")
    rows = ht.ingest_commit_log(ht.read_blocks(spark, str(tmp_path / "log"), ht.COMMIT_MARK)).collect()
    assert {(r["author"], r["ts"], r["subject"], r["path"]) for r in rows} == {("Ann", 100.0, "fix: a", "a.go"), ("Ann", 100.0, "fix: a", "b.go")}
    (tmp_path / "stat").write_text("__AUTHOR__\n Ann \n\n3\t1\ta.go\n-\t-\tb.png\n__AUTHOR__\nBob\n2\t0\tc d.go\n")
    rows = ht.ingest_numstat(ht.read_blocks(spark, str(tmp_path / "stat"), ht.AUTHOR_MARK)).collect()
    assert {(r["author"], r["added"], r["path"]) for r in rows} == {("Ann", 3, "a.go"), ("Bob", 2, "c d.go")}
    refs = spark.createDataFrame([("r", "main\t5"), ("r", "x"), ("r", " a/b \t7 ")], "repo string, text string")
    assert {tuple(r) for r in ht.ingest_branches(refs).collect()} == {("r", "main", 5), ("r", "a/b", 7)}


def test_commit_export_and_heads(spark, tmp_path):
    records = [
        "aa\x1fbb cc\x1fAnn\x1f100\x1fMerge: x\n\nbody\tline\n\x1d\n",
        "bb\x1fcc\x1fBob B\x1f90\x1ffix: __COMMIT__\n\x1d\n\na.go\nd e/b.go\n",
        "cc\x1f\x1f\x1fno\x1f\x1d",
        "broken",
    ]
    (tmp_path / "log").write_text("".join("\x1e" + r for r in records))
    blocks = ht.read_blocks(spark, str(tmp_path / "log"), ht.RECORD_MARK).withColumn("seq", F.monotonically_increasing_id()).withColumn("repo", F.lit("r"))
    got = ht.ingest_commits(blocks)
    want = {
        ("aa", ("bb", "cc"), "Ann", 100, "Merge: x", "Merge: x\n\nbody\tline", ()),
        ("bb", ("cc",), "Bob B", 90, "fix: __COMMIT__", "fix: __COMMIT__", ("a.go", "d e/b.go")),
        ("cc", (), "", 0, "", "", ()),
    }
    rows = got.collect()
    assert {(r["hash"], tuple(r["parents"]), r["author"], r["ts"], r["subject"], r["message"], tuple(r["paths"])) for r in rows} == want
    assert [r["hash"] for r in sorted(rows, key=lambda r: r["log_seq"])] == ["aa", "bb", "cc"]
    assert {tuple(r) for r in ht.commit_paths(got).collect()} == {("r", "bb", "a.go"), ("r", "bb", "d e/b.go")}
    lines = [("r", "*\ttrunk\t5\taa"), ("r", " \tx/y\t7\tbb"), ("q", " \tmaster\t1\tcc"), ("q", "*\tdev\tz\tdd"), ("q", "bad")]
    heads = ht.ingest_heads(spark.createDataFrame(lines, "repo string, text string"))
    assert {tuple(r) for r in heads.collect()} == {("r", "trunk", 5, "aa", True), ("r", "x/y", 7, "bb", False), ("q", "master", 1, "cc", False), ("q", "dev", 0, "dd", True)}
    assert {tuple(r) for r in br.default_branch(heads).collect()} == {("r", "HEAD", "aa"), ("q", "master", "cc")}
    on_main = br.main_commits(got, heads.where("repo = 'r'"))
    assert {r["hash"] for r in on_main.collect()} == {"aa", "bb", "cc"}


def test_exports_of_several_repositories(spark, tmp_path):
    """Places follow the files' names and their bytes, also where one file is read in many splits; names of folders stay text."""
    want = []
    for repo, files in (("007", 1), ("a b", 3)):
        folder = tmp_path / f"repo={repo}"
        folder.mkdir()
        blocks = [f"{repo} {i}\nsecond line " + "x" * (i * 37 % 90) for i in range(900)]
        for k in range(files):
            part = blocks[k * 900 // files : (k + 1) * 900 // files]
            (folder / f"part-{k}").write_text("".join("\x1e" + b for b in part))
        want += [(repo, b, i + 1) for i, b in enumerate(blocks)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = ht.read_exports(spark, str(tmp_path), ht.RECORD_MARK)
        assert spark.read.option("lineSep", ht.RECORD_MARK).text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = spark.createDataFrame([(r, b, -n) for r, b, n in want], "repo string, block string, o int")
    back = ht.read_exports(spark, ht.write_exports(rows, "o", str(tmp_path / "back"), ht.RECORD_MARK), ht.RECORD_MARK)
    assert sorted(map(tuple, back.collect())) == sorted((r, b, 901 - n) for r, b, n in want)


def test_files_and_sink(spark, tmp_path):
    (tmp_path / "w" / "a").mkdir(parents=True)
    (tmp_path / "w" / "a" / "x.go").write_text("package a\n")
    (tmp_path / "w" / "Makefile").write_text("all:\n")
    files = src.read_tree_files(spark, str(tmp_path / "w"))
    got = {r["path"]: bytes(r["content"]) for r in files.collect()}
    assert got == {"a/x.go": b"package a\n", "Makefile": b"all:\n"}
    assert {r["path"] for r in src.scan_manifests(files).collect()} == {"Makefile"}
    out = str(tmp_path / "mart")
    for day, n in (("2024-01-01", 3), ("2024-01-02", 2), ("2024-01-01", 1)):
        store.write_mart(spark.range(n), out, day)
    got = {str(r["run_date"]): r["count"] for r in spark.read.parquet(out).groupBy("run_date").count().collect()}
    assert got == {"2024-01-01": 1, "2024-01-02": 2}
    paths = store.write_marts({"one": spark.range(2), "two": spark.range(3)}, str(tmp_path / "marts"), "2024-02-01")
    assert {n: spark.read.parquet(p).where("run_date = '2024-02-01'").count() for n, p in paths.items()} == {"one": 2, "two": 3}


def test_commit_messages_and_versions(spark):
    subjects = {
        "feat: a": "feat", "fix(x)!: b": "fix", "style: c": "style", "feat a": None, "PROJ-1 x": "ticket", "see #12": "ticket",
        "Fix: upper": None, "revert(a)(b): x": "revert", "": None,
    }
    rows = [("r", 0, f"h{i}", "a", 1, s, s, i, []) for i, s in enumerate(subjects)]
    done = history.classify_commits(spark.createDataFrame(rows, COMMITS))
    assert {r["subject"]: r["commit_type"] for r in done.collect()} == subjects
    tags = spark.createDataFrame([(t,) for t in ("v1.2.3", "1.10.0", "v1.9.9", "1.10.0-rc1", "x", "v1.2", "1.10.0.5")], "tag string")
    assert tuple(history.tag_stats(tags).first()) == (7, 5)
    assert history.latest_semver(tags).first()[0] == "1.10.0"


def test_hot_file_top_authors(spark):
    rows = [("r", "hot" if i % 3 else f"p{i % 5}", f"a{i % 7}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "repo string, path string, author string, ts bigint")
    got = {r["path"]: list(r["top_authors"]) for r in history.top_authors_per_file(df).collect()}
    for path, names in got.items():
        counts: dict[str, int] = {}
        for _, p, a, _ in rows:
            if p == path:
                counts[a] = counts.get(a, 0) + 1
        assert names == sorted(counts, key=lambda a: (-counts[a], a))[:3]


def test_stale_and_days(spark):
    now = 1_700_000_000
    inv = spark.createDataFrame([("main", 1), ("old", now - 31 * 86_400 - 5), ("new", now - 86_400), ("none", 0)], "name string, ts bigint")
    assert [(r["name"], r["days_inactive"]) for r in br.stale_branches(inv, now, 0).collect()] == [("old", 31)]
    commits = spark.createDataFrame([("r", i, i * 86_400 * 7 + 86_400) for i in range(1, 4)], "repo string, log_seq bigint, ts bigint")
    want = commits.select(F.date_format(F.timestamp_seconds("ts"), "EEEE")).first()[0]
    assert tuple(br.peak_commit_day(commits).first()) == (want, 3)


def test_branch_listed_twice(spark):
    """Of rows with one name in one repository the first listed stays, in any order of rows."""
    rows = [("/r1", 1, "a", 50, 0), ("/r0", 0, "a", 10, 7), ("/r0", 0, "a", 30, 3), ("/r0", 0, "a", 20, 9), ("/r1", 1, "b/c", 5, 2), ("/r1", 1, "b/c", 4, 1)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "repo string, repo_ord int, name string, ts long, place long").coalesce(1)
        assert {tuple(r) for r in br.branch_inventory(df).collect()} == {("a", "/r0", 30, 1), ("b/c", "/r1", 4, 2)}
        assert {r["ts"] for r in br.branch_inventory(df.drop("place")).collect()} == {30, 5}


def test_counted_touches(spark):
    """Touches counted by file and author, with the lines added, give what the touches themselves give, with repeated and null keys."""
    rng = random.Random(11)
    commits = [("r", 0, f"h{i % 38}", rng.choice(("ann", "bob", "cy", None)), 10 + i, "s", "m", i, []) for i in range(40)]
    commits_df = spark.createDataFrame(commits, COMMITS)
    files = [(rng.choice(("r", None)), f"h{rng.randrange(45)}", rng.choice(("a.go", "b.go", "d/c.go", None)), rng.choice((None, 0, 3, 8))) for _ in range(300)]
    files_df = spark.createDataFrame(files, "repo string, hash string, path string, added int")
    counted, touches = history.file_authors(commits_df, files_df), history.file_touches(commits_df, files_df)
    assert sum(r["n"] for r in counted.collect()) == touches.count() > 100
    for job in (lambda t: history.top_authors(t, ["repo", "path"]), lambda t: history.churn(t, 2)):
        got = job(counted)
        assert got.dtypes == job(touches).dtypes and sorted(map(str, got.collect())) == sorted(map(str, job(touches).collect()))
    stat = files_df.join(commits_df.select("repo", "hash", "author"), ["repo", "hash"]).select("author", "added")
    authors = history.author_stats(commits_df)
    assert sorted(history.author_loc(counted, authors).collect()) == sorted(history.author_loc(stat, authors).collect())


def test_marts_are_written_side_by_side(spark, tmp_path):
    """Marts that wait for each other are written, and what both need is made once."""
    made, both = [], Barrier(2, timeout=60)
    base = Codebase(spark, str(tmp_path))

    def shared():
        made.append(1)
        return spark.range(5)

    def mart(least):
        both.wait()
        return base.stage("shared", shared).where(f"id >= {least}")

    paths = store.write_marts({"low": lambda: mart(0), "high": lambda: mart(3), "plain": spark.range(2)}, str(tmp_path), "2024-01-01")
    assert list(paths) == ["low", "high", "plain"] and made == [1]
    assert [spark.read.parquet(p).where("run_date = '2024-01-01'").count() for p in paths.values()] == [5, 2, 2]
