"""File dependency graph: edges from imports and type references, degrees, PageRank, hot zones.

A vertex is a file's absolute path (column ``id``). ``files``: id, service, package, file_type,
line_count; ``imports``: id, import; ``declarations``: id, service, pos, name, kind;
``lines``: id, line_no, text.

Links of a word that many files mention and many declare grow with the square of the files. ``Links`` keeps them as
pairs of classes of files; degrees and scores are computed from the classes, and ``pairs`` writes the links out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.functions.scan import grid_join
from codequarry.sources.store import discard, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need the public libraries only

BLOCK_ROWS = 65_536
PACK_LINKS = 1 << 18
#: Words with more pairs than this per mention and declaration are kept as classes.
PAIRS_PER_MENTION = 16
LINK, MEMBER, CLASS = 0, 1, 2
#: Characters by which words are sorted out before they are shuffled, and the most beginnings to compare with.
BEGINNING, BEGINNINGS = 3, 1024
REF_KINDS = ("struct", "interface", "message", "service")


def vertices(files: DataFrame) -> DataFrame:
    return files.select("id").distinct()


def name_map(files: DataFrame) -> DataFrame:
    """Name -> file, for file stems and package names; the last file in walk order wins, package after stem."""
    order = F.split(F.col("id"), "/")
    stem = files.select(text.file_stem(F.col("id")).alias("name"), "id", F.struct(order.alias("o"), F.lit(0).alias("slot")).alias("at"))
    package = files.where("package <> ''").select(
        F.col("package").alias("name"), "id", F.struct(order.alias("o"), F.lit(1).alias("slot")).alias("at")
    )
    return stem.unionByName(package).groupBy("name").agg(F.max_by("id", "at").alias("id"))


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """File -> file named like the last segment of one of its imports.

    Imports are made distinct per (file, segment) first; the name side has one row per name.
    """
    wanted = imports.select(F.col("id").alias("src"), F.substring_index("import", "/", -1).alias("name")).distinct()
    targets = name_map(files).select("name", F.col("id").alias("dst"))
    return wanted.join(targets, "name").where("src <> dst").select("src", "dst").distinct()


def file_words(lines: DataFrame, min_bytes: int = 1, sought: DataFrame | None = None) -> DataFrame:
    """Distinct (id, word) of the lines' identifier tokens; shorter words are dropped at the scan.

    ``sought`` (word, a written table): so are those that begin like none of these words, unless they have more than
    ``BEGINNINGS``. What is left is for the caller to join: it only has less to shuffle.
    """
    keep = lambda w: F.length(w) >= min_bytes
    if sought is not None:
        first = [r[0] for r in sought.select(F.substring("word", 1, BEGINNING)).distinct().limit(BEGINNINGS + 1).collect()]
        if len(first) <= BEGINNINGS:
            keep = lambda w: (F.length(w) >= min_bytes) & F.substring(w, 1, BEGINNING).isin(first)
    return lines.select("id", F.explode(F.filter(text.words(F.col("text")), keep)).alias("word")).distinct()


@dataclass(frozen=True)
class Links:
    """A link graph whose largest groups of links are not written out as pairs.

    ``single``: src, dst, every link once. ``classes``: id, src_class, dst_class (null: none), a row per file with a class.
    ``joined``: src_class, dst_class; each file of the first links to each file of the second, itself excepted.
    No single link lies in a joined pair of classes, so the two parts have no link in common.
    """

    single: DataFrame
    classes: DataFrame
    joined: DataFrame

    def own(self) -> DataFrame:
        """Files (id) whose own two classes are joined: the links to themselves that don't count."""
        return self.classes.join(self.joined, ["src_class", "dst_class"], "left_semi").select("id")

    def pairs(self) -> DataFrame:
        """Every link as src, dst. The classes meet in cells of bounded size; nothing is sorted or made distinct after it."""
        src = self.classes.select(F.col("id").alias("src"), "src_class").join(self.joined, "src_class").select("src", "dst_class")
        dst = self.classes.where("dst_class IS NOT NULL").select(F.col("id").alias("dst"), "dst_class")
        wide = grid_join(src, dst, ["dst_class"], "src", "dst").where("src <> dst").select("src", "dst")
        return self.single.unionByName(wide)


def ref_links(
    files: DataFrame, lines: DataFrame, declarations: DataFrame, min_bytes: int = 3, pairs_per_mention: int = PAIRS_PER_MENTION
) -> Links:
    """File -> file of the same service that declares a type the first one mentions.

    A whole-word search for an identifier equals membership in the file's token set, so the search is
    an equality join of (service, word). Words nobody declares are removed before the join. Words with more than
    ``pairs_per_mention`` pairs per mention and declaration are not joined: files that mention the same such words
    form a class, files that declare the same ones another, and classes with a common word are joined.
    """
    group = F.when(F.col("service") == "", "__root__").otherwise(F.col("service"))
    decls = declarations.where(F.col("kind").isin(*REF_KINDS) & (F.octet_length("name") >= min_bytes)).select(
        group.alias("service"), "name", "id"
    )
    key = ["service", "word"]
    targets = settle(decls.select("service", F.col("name").alias("word"), "id").distinct(), "ref-targets")
    used = file_words(lines, min_bytes, targets).join(targets.select("word").distinct(), "word", "left_semi")
    sources = settle(used.join(files.select("id", group.alias("service")), "id").select(*key, "id"), "ref-sources")
    sizes = sources.groupBy(*key).agg(F.count(F.lit(1)).alias("s")).join(targets.groupBy(*key).agg(F.count(F.lit(1)).alias("t")), key)
    frequent = settle(sizes.where(F.col("s") * F.col("t") > pairs_per_mention * (F.col("s") + F.col("t"))).select(*key), "ref-frequent")

    def classes(side: DataFrame, name: str) -> DataFrame:
        words = side.join(frequent, key, "left_semi").groupBy("service", "id").agg(F.sort_array(F.collect_set("word")).alias("words"))
        return settle(words.withColumn(name, F.concat_ws("\x1f", "service", "words")), "ref-classes")

    def class_words(side: DataFrame, name: str) -> DataFrame:
        return side.select(name, "service", "words").distinct().select(name, "service", F.explode("words").alias("word"))

    src, dst = classes(sources, "src_class"), classes(targets, "dst_class")
    joined = class_words(src, "src_class").join(class_words(dst, "dst_class"), key).select("src_class", "dst_class").distinct()
    both = src.select("id", "src_class").join(dst.select("id", "dst_class"), "id", "full")
    rare = sources.join(frequent, key, "left_anti").select(*key, F.col("id").alias("src"))
    single = rare.join(targets.select(*key, F.col("id").alias("dst")), key).select("src", "dst")
    return _without_joined(single, both, settle(joined, "ref-joined"))


def _without_joined(single: DataFrame, classes: DataFrame, joined: DataFrame) -> Links:
    """``Links`` of any single links: each once, without loops and without those that the classes have."""
    src = classes.where("src_class IS NOT NULL").select(F.col("id").alias("src"), "src_class")
    dst = classes.where("dst_class IS NOT NULL").select(F.col("id").alias("dst"), "dst_class")
    each = single.select("src", "dst").where("src <> dst").distinct().join(src, "src", "left").join(dst, "dst", "left")
    return Links(each.join(joined, ["src_class", "dst_class"], "left_anti").select("src", "dst"), classes, joined)


def type_ref_edges(files: DataFrame, lines: DataFrame, declarations: DataFrame, min_bytes: int = 3) -> DataFrame:
    """The links of ``ref_links`` as pairs."""
    return ref_links(files, lines, declarations, min_bytes).pairs()


def link_graph(vertex: DataFrame, refs: Links, *parts: DataFrame) -> Links:
    """``refs`` and further edge sets as one graph without loops, unknown ends and duplicates."""
    known = refs.classes.join(vertex.select("id"), "id", "left_semi")
    return _without_joined(edges(vertex, refs.single, *parts), known, refs.joined)


def token_overlap(docs: DataFrame, names: DataFrame, min_chars: int = 3) -> DataFrame:
    """The token join on free text: group-wise mentions of ``names(word, owner)`` in ``docs(id, grp, text)``."""
    word = F.filter(text.words(F.col("text")), lambda w: F.length(w) >= min_chars)
    used = docs.select("id", "grp", F.explode(word).alias("word"))
    # counted before the join: a frequent word is one row per group, not one per mention
    counts = used.groupBy("grp", "word").agg(F.count(F.lit(1)).alias("_n"))
    return counts.join(names, "word").groupBy("grp", "word").agg(F.sum("_n").alias("mentions"))


def edges(vertex: DataFrame, *parts: DataFrame) -> DataFrame:
    """Union of edge sets without loops, unknown ends and duplicates."""
    out = parts[0].select("src", "dst")
    for p in parts[1:]:
        out = out.unionByName(p.select("src", "dst"))
    out = out.where("src <> dst").distinct()
    out = out.join(vertex.select(F.col("id").alias("src")), "src", "left_semi")
    return out.join(vertex.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def degrees(vertex: DataFrame, edge: DataFrame | Links) -> DataFrame:
    """Out- and in-degree of every vertex, 0 without edges; one aggregation for both directions. Classes are counted, not expanded."""
    single = edge.single if isinstance(edge, Links) else edge
    ends = single.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).cast("long").alias("o"), F.lit(0).cast("long").alias("i")),
                                           F.struct(F.col("dst").alias("id"), F.lit(0).cast("long").alias("o"), F.lit(1).cast("long").alias("i")))).alias("e")).select("e.*")
    parts = [vertex.select("id", F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("i"))]
    if isinstance(edge, Links):
        n_src = edge.classes.groupBy("src_class").agg(F.count(F.lit(1)).alias("n"))
        n_dst = edge.classes.groupBy("dst_class").agg(F.count(F.lit(1)).alias("n"))
        out = edge.joined.join(n_dst, "dst_class").groupBy("src_class").agg(F.sum("n").alias("n"))
        into = edge.joined.join(n_src, "src_class").groupBy("dst_class").agg(F.sum("n").alias("n"))
        zero = F.lit(0).cast("long")
        parts.append(edge.classes.join(out, "src_class").select("id", F.col("n").alias("o"), zero.alias("i")))
        parts.append(edge.classes.join(into, "dst_class").select("id", zero.alias("o"), F.col("n").alias("i")))
        parts.append(edge.own().select("id", F.lit(-1).cast("long").alias("o"), F.lit(-1).cast("long").alias("i")))
    for part in parts:
        ends = ends.unionByName(part)
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _numbers(frame: pd.DataFrame, **columns: np.ndarray) -> pd.DataFrame:
    """One row of the frame's keys with the columns as bytes."""
    return frame.iloc[:1].assign(**{name: [x.tobytes()] for name, x in columns.items()})


def _pack(links: pd.DataFrame) -> pd.DataFrame:
    """The links of a pair of blocks (and a salt) as numbers: each link as the places of its source and target in lists."""
    sources, s = np.unique(links["s"].to_numpy(), return_inverse=True)
    targets, t = np.unique(links["t"].to_numpy(), return_inverse=True)
    share = np.empty(len(sources))
    share[s] = links["share"].to_numpy()
    packed = _numbers(links[["sb", "salt", "db"]], sources=sources.astype(np.int32), share=share, targets=targets.astype(np.int32), s=s.astype(np.int32), t=t.astype(np.int32))
    return packed.assign(blocks=None)


def _pack_classes(senders: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """A block's vertices with their classes, and the classes of all blocks that each of its classes links to, block by block."""
    wanted = wanted.sort_values(["db", "slot"], kind="stable")
    int32 = {name: senders[c].to_numpy(np.int32) for name, c in (("sources", "s"), ("s", "c"))}
    to = {name: wanted[c].to_numpy(np.int32) for name, c in (("targets", "slot"), ("t", "c"), ("blocks", "db"))}
    return _numbers(senders[["sb"]], share=senders["share"].to_numpy(np.float64), **int32, **to).assign(salt=0, db=-1)


def _pack_members(members: pd.DataFrame) -> pd.DataFrame:
    """The places of a block's vertices that have a class, and these classes."""
    return _numbers(members[["block"]], targets=members["at"].to_numpy(np.int32), given=members["slot"].to_numpy(np.int32)).assign(kind=MEMBER)


def _give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each packed row gives to its targets, summed per target; a row of classes gives to classes of all blocks."""

    def row(block: int, kind: int, targets: bytes, given: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([block], pa.int32()), pa.array([kind], pa.int32()), pa.array([targets], pa.binary()), pa.array([given.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "kind", "targets", "given"])

    for batch in batches:
        for r in batch.to_pylist():
            sources, targets, s, t = (np.frombuffer(r[c], np.int32) for c in ("sources", "targets", "s", "t"))
            given = np.frombuffer(r["scores"])[sources] * np.frombuffer(r["share"])
            if r["blocks"] is None:
                yield row(r["db"], LINK, r["targets"], np.bincount(t, given[s], len(targets)))
                continue
            blocks = np.frombuffer(r["blocks"], np.int32)
            start = np.flatnonzero((np.diff(blocks, prepend=-1) != 0) | (np.diff(targets, prepend=-1) != 0))
            sums = np.add.reduceat(np.bincount(s, given)[t], start)
            edge = np.flatnonzero(np.diff(blocks[start], prepend=-1)).tolist() + [len(start)]
            for lo, hi in zip(edge, edge[1:]):
                yield row(int(blocks[start[lo]]), CLASS, targets[start[lo:hi]].tobytes(), sums[lo:hi])


def _take(base: float, damping: float, block_rows: int, block_classes: int):
    """Scores of the blocks that come to this task, whose partial sums pass by one after the other."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        of_class: dict[int, np.ndarray] = {}
        members: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, kind, targets, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = total.setdefault(block, np.zeros(block_rows))
                places = np.frombuffer(targets, np.int32)
                if kind == MEMBER:
                    members[block] = places, np.frombuffer(given, np.int32)
                elif kind == CLASS:
                    of_class.setdefault(block, np.zeros(block_classes))[places] += np.frombuffer(given)
                else:
                    own[places] += np.frombuffer(given)
        for block, own in total.items():
            if block in of_class:
                places, classes = members[block]
                own[places] += of_class[block][classes]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(base + damping * own).tobytes()], pa.binary())], ["sb", "scores"])

    return taken


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """No new plan after each stage: rounds are alike and their tables' sizes known, so replanning only costs time."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values = np.frombuffer(scores)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), block, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["block", "at", "score"])


def _class_slots(members: DataFrame, block: str, name: str, slot: str) -> DataFrame:
    """The classes of each block's members, numbered from 0."""
    number = F.row_number().over(Window.partitionBy(block).orderBy(name)) - 1
    return settle(members.select(block, name).distinct().withColumn(slot, number.cast("int")), "rank-slots")


def pagerank(
    vertex: DataFrame,
    edge: DataFrame | Links,
    damping: float = 0.85,
    iterations: int = 100,
    settle_every: int = 4,
    block_rows: int = BLOCK_ROWS,
    pack_links: int = PACK_LINKS,
) -> DataFrame:
    """Scores after a fixed number of rounds from 1/n; the share of vertices without out-edges is lost.

    Vertices get a block of about ``block_rows`` and a place in it. Links are packed once: one row of numbers per pair
    of blocks and salt, with a salt, a hash of the target, for every ``pack_links`` links of a block; so a hub's links
    spread over rows and tasks. Scores are one row per block. A round joins them to the packed rows (which stay where they
    are), sums what each packed row gives to each of its targets, and adds these sums per block as they stream by: no link
    is sorted, joined or shuffled after packing. Scores go to the shared folder every ``settle_every`` rounds, which bounds
    the plan and what is computed again; the table before is deleted then.

    Of ``Links``, the classes are packed as well: a block's row sums its vertices by class and gives each class of each block
    its sum, which the block hands to the class's members. What a vertex so gives to itself is taken back by a link of minus its share.
    """
    spark = vertex.sparkSession
    vertex = vertex.select("id").distinct()
    n = vertex.count()
    base, start = (1.0 - damping) / max(n, 1), 1.0 / max(n, 1)
    if n == 0 or iterations < 1:
        return vertex.select("id", F.lit(start).alias("score"))
    blocks = -(-n // block_rows)
    numbered = vertex.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1
    numbered = settle(numbered.withColumn("at", place.cast("int")), "rank-vertices")
    wide = numbered.groupBy("block").count().agg(F.max("count")).first()[0]
    single = edge.single if isinstance(edge, Links) else edge
    if isinstance(edge, Links):
        degree = degrees(vertex, edge).where("out_degree > 0").select(F.col("id").alias("src"), "out_degree")
    else:
        degree = edge.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))
    source = numbered.select(F.col("id").alias("src"), F.col("block").alias("sb"), F.col("at").alias("s"))
    source = settle(source.join(degree, "src").select("src", "sb", "s", (1.0 / F.col("out_degree")).alias("share")), "rank-shares")
    target = numbered.select(F.col("id").alias("dst"), F.col("block").alias("db"), F.col("at").alias("t"))
    links = single.join(source, "src").join(target, "dst").select("sb", "db", "s", "t", "share", F.lit(False).alias("own"))
    if isinstance(edge, Links):
        own = edge.own().join(source.withColumnRenamed("src", "id"), "id")
        links = links.unionByName(own.select("sb", F.col("sb").alias("db"), "s", F.col("s").alias("t"), (-F.col("share")).alias("share"), F.lit(True).alias("own")))
    links = settle(links, "rank-links")
    sending, block_classes, members = links.select("sb"), 0, None
    schema = "sb int, salt int, db int, sources binary, share binary, targets binary, s binary, t binary, blocks binary"
    if isinstance(edge, Links):
        into = edge.classes.join(edge.joined.select("dst_class").distinct(), "dst_class", "left_semi").join(numbered, "id")
        slots = _class_slots(into, "block", "dst_class", "slot")
        block_classes = (slots.agg(F.max("slot")).first()[0] or 0) + 1
        members = into.join(slots, ["block", "dst_class"]).select("block", "at", "slot").groupBy("block")
        members = members.applyInPandas(_pack_members, "block int, kind int, targets binary, given binary")
        senders = edge.classes.join(edge.joined.select("src_class").distinct(), "src_class", "left_semi").join(source.withColumnRenamed("src", "id"), "id")
        sent_classes = _class_slots(senders, "sb", "src_class", "c")
        senders = settle(senders.join(sent_classes, ["sb", "src_class"]).select("sb", "s", "share", "c"), "rank-senders")
        wanted = sent_classes.join(edge.joined, "src_class").join(slots.withColumnRenamed("block", "db"), "dst_class").select("sb", "c", "db", "slot")
        sending = sending.unionByName(senders.select("sb"))
    size = settle(sending.groupBy("sb").agg(F.ceil(F.count(F.lit(1)) / pack_links).cast("int").alias("salts")), "rank-salts")
    salted = links.join(size, "sb").withColumn("salt", F.pmod(F.xxhash64("db", "t"), F.col("salts")).cast("int")).drop("salts")
    packed = salted.groupBy("sb", "salt", "db", "own").applyInPandas(_pack, schema)
    if isinstance(edge, Links):
        packed = packed.unionByName(senders.groupBy("sb").cogroup(wanted.groupBy("sb")).applyInPandas(_pack_classes, schema))
    packed = settle(packed, "rank-packed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    empty = F.lit(b"")
    every = numbered.select("block").distinct().select("block", F.lit(LINK).alias("kind"), empty.alias("targets"), empty.alias("given"))
    first = numbered.select("block").distinct().select(F.col("block").alias("sb"), F.lit(np.full(wide, start).tobytes()).alias("scores"))
    every = settle(every if members is None else every.unionByName(members), "rank-blocks")
    scores, written = settle(first, "rank-scores"), None
    with planned_once(spark):
        kept = packed.repartition(parts, "sb", "salt").persist()
        for step in range(1, iterations + 1):
            sent = scores.join(size, "sb").select("sb", "scores", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
            flow = kept.join(sent.hint("shuffle_hash"), ["sb", "salt"]).select("db", "sources", "share", "targets", "s", "t", "blocks", "scores").mapInArrow(_give, "block int, kind int, targets binary, given binary").unionByName(every)
            scores = flow.repartition(min(parts, blocks), "block").mapInArrow(_take(base, damping, wide, block_classes), "sb int, scores binary")
            if step % settle_every == 0 or step == iterations:
                before, scores = written, settle(scores, "rank-scores")
                written = scores
                if before is not None:
                    discard(before)
    kept.unpersist()
    return numbered.join(scores.mapInArrow(_unpack, "block int, at int, score double"), ["block", "at"]).select("id", "score")


def _rank_key():
    """Scores as compared: sums may differ in the last bits from run to run, and ties go by id."""
    return F.desc(F.round("score", 12))


def top_hotspots(scores: DataFrame, n: int = 30) -> DataFrame:
    return scores.orderBy(_rank_key(), "id").limit(n)


def hot_zones(scores: DataFrame, files: DataFrame, pool: int = 30, n: int = 10) -> DataFrame:
    """The best files of the pool without ``module.go``, with size, declarations and display path.

    ``files``: id, service, line_count, declaration_count.
    """
    best = top_hotspots(scores, pool).where(text.file_name(F.col("id")) != "module.go")
    best = best.orderBy(_rank_key(), "id").limit(n)
    # at most ``n`` rows on this side
    rows = files.join(F.broadcast(best), "id", "right")
    service = F.when(F.coalesce("service", F.lit("")) == "", "root").otherwise(F.col("service"))
    shown = text.short_path(F.col("id"), F.col("svc"))
    return rows.withColumn("svc", service).select(
        "id",
        text.dir_of(shown).alias("display_dir"),
        text.file_name(shown).alias("display_file"),
        "score",
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("declaration_count", F.lit(0)).alias("declaration_count"),
        F.col("svc").alias("service"),
    )
