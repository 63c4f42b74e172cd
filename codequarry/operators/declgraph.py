"""Declaration graph per service, and the service / technology architecture graph.

``nodes``: service, id (file::name), file, name, kind, score; links that nobody ranks go without the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.scan import grid_join, place_in_group
from codequarry.operators.graph import file_words
from codequarry.sources.store import settle

TYPE_KINDS = ("struct", "interface", "message", "service", "enum")
MIN_SCORE = 0.001
LIST_ROWS = 256
#: Targets of a word up to which pairs of file and target are made before the file's sources come in.
FEW = 16


def _named(declarations: DataFrame, big_functions: DataFrame) -> DataFrame:
    """Types and enums (names of 3 bytes or more), functions once per file, and big functions: service, file, slot, pos, name, kind."""
    long_name = F.octet_length("name") >= 3
    types = declarations.where(F.col("kind").isin(*TYPE_KINDS) & long_name).select(
        "service", F.col("id").alias("file"), F.lit(0).alias("slot"), "pos", "name", "kind"
    )
    funcs = declarations.where((F.col("kind") == "func") & long_name).select(
        "service", F.col("id").alias("file"), F.lit(0).alias("slot"), "pos", "name", "kind"
    )
    big = big_functions.select(
        "service", F.col("id").alias("file"), F.lit(1).alias("slot"), "pos", "name", F.lit("func").alias("kind")
    )
    once = (
        funcs.unionByName(big)
        .groupBy("service", "file", "name", "kind")
        .agg(F.min(F.struct("slot", "pos")).alias("at"))
        .select("service", "file", "at.slot", "at.pos", "name", "kind")
    )
    return types.unionByName(once)


def decl_names(declarations: DataFrame, big_functions: DataFrame) -> DataFrame:
    """The nodes without their score, which needs the files' PageRank: enough for links that nobody ranks."""
    return _named(declarations, big_functions).select("service", F.concat_ws("::", "file", "name").alias("id"), "file", "name", "kind")


def decl_nodes(declarations: DataFrame, big_functions: DataFrame, scores: DataFrame, node_cap: int | None = None) -> DataFrame:
    """The nodes of ``decl_names`` with their file's score.

    ``declarations``: id (file), service, pos, name, kind; ``big_functions``: id, service, pos, name.
    ``scores``: id, score, the files' PageRank. ``node_cap``, for a viewer, keeps the declarations of the
    best-scored files of each service.
    """
    found = _named(declarations, big_functions).join(scores.select(F.col("id").alias("file"), "score"), "file", "left")
    found = found.withColumn("score", F.coalesce("score", F.lit(0.0)))
    if node_cap is not None:
        order = Window.partitionBy("service").orderBy(F.desc(F.round("score", 12)), F.split(F.col("file"), "/"), "slot", "pos", "name")
        found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= node_cap)
    return found.select(
        "service",
        F.concat_ws("::", "file", "name").alias("id"),
        "file",
        "name",
        "kind",
        F.greatest("score", F.lit(MIN_SCORE)).alias("score"),
    )


_LINK = ["service", "src", "dst", "src_kind", "dst_kind"]


def _score_of_target(nodes: DataFrame) -> list[Column]:
    """Links carry the target's score where the nodes have one."""
    return [F.col("score").alias("dst_score")] if "score" in nodes.columns else []


def _references(sources: DataFrame, targets: DataFrame, lines: DataFrame, elsewhere: bool) -> DataFrame:
    """Source -> target whose name (5 bytes or more) occurs in the source's file, each pair once; both ends of one service.

    ``elsewhere``: only targets of other files and other names. Files that mention a word meet its targets before the files'
    sources, kept as lists, are joined, if the word has at most ``FEW`` targets. Of other words the files come with their lists,
    and ``grid_join`` writes neither side more often than once. Both sides are distinct before, and the name is part of the
    target's id, so pairs need no shuffle and no ``distinct`` after the join.
    """
    score = _score_of_target(targets)
    scored = ["dst_score"] * len(score)
    key, per_file = ["service", "word"], ["service", "file"]
    to = targets.where(F.octet_length("name") >= 5).select(
        "service", F.col("name").alias("word"), F.col("id").alias("dst"), F.col("file").alias("dst_file"),
        F.col("kind").alias("dst_kind"), *score,
    ).distinct()
    to = settle(to, "targets")
    ends = sources.select(*per_file, F.struct(F.col("id").alias("src"), F.col("name").alias("src_name"), F.col("kind").alias("src_kind")).alias("s")).distinct()
    lists = ends.join(ends.groupBy(*per_file).agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("lists")), per_file)
    lists = lists.groupBy(*per_file, F.pmod(F.xxhash64("s.src"), "lists").alias("list")).agg(F.collect_list("s").alias("sources"))
    lists = lists.withColumn("list", F.xxhash64("file", "list"))
    words = file_words(lines, 5, to).join(to.select("word").distinct(), "word", "left_semi").withColumnRenamed("id", "file")
    words = words.join(sources.select(*per_file).distinct(), "file")
    words = settle(words.join(to.groupBy(*key).agg((F.count(F.lit(1)) > FEW).alias("many")), key), "source-words")
    few = words.where("NOT many").drop("many").join(to, key)
    many = words.where("many").drop("many")
    listed = many.join(lists.join(many.select(*per_file).distinct(), per_file, "left_semi"), per_file)
    found = grid_join(listed, to.join(many.select(*key).distinct(), key, "left_semi"), key, "list", "dst")
    if elsewhere:
        few, found = few.where("dst_file <> file"), found.where("dst_file <> file")
    found = few.join(lists.drop("list"), per_file).unionByName(found.drop("list"))
    rows = found.select("service", "word", "dst", "dst_kind", *scored, F.inline("sources"))
    return (rows.where("word <> src_name") if elsewhere else rows).select(*_LINK, *scored)


def decl_ref_edges(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Declaration -> declaration of another file whose name occurs in the source's file."""
    return _references(nodes, nodes, lines, True)


def colocation_groups(nodes: DataFrame) -> DataFrame:
    """Co-location as membership, for files of any size: service, file, id, n_links (other names declared in the file).

    One row per declaration in place of one per pair. As an id is its file and name, the links of a declaration lead
    to all other ids of its group; ``colocation_edges(nodes, most=None)`` writes them out where that is wanted.
    """
    members = nodes.select("service", "file", "id").distinct()
    size = members.groupBy("service", "file").agg(F.count(F.lit(1)).alias("n"))
    return members.join(size, ["service", "file"]).select("service", "file", "id", (F.col("n") - 1).alias("n_links"))


def colocation_edges(nodes: DataFrame, least: int = 2, most: int | None = 20) -> DataFrame:
    """Ordered pairs of differently named declarations of one file with ``least`` to ``most`` nodes (None: any number).

    With the usual 20 a file yields at most 380 pairs; without a bound the pairs of a file grow with its square. A node's id
    holds its file and name, so pairs of distinct nodes are distinct and need no shuffle of their own.
    """
    per_file = ["service", "file"]
    size = nodes.groupBy(*per_file).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if most is not None:
        size = size.where(F.col("n") <= most)
    small = nodes.join(size.drop("n"), per_file, "left_semi")
    src = small.select(*per_file, F.col("id").alias("src"), F.col("name").alias("src_name"), F.col("kind").alias("src_kind")).distinct()
    score = _score_of_target(nodes)
    dst = small.select(*per_file, F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("kind").alias("dst_kind"), *score).distinct()
    return src.join(dst, per_file).where("src_name <> dst_name").select(*_LINK, *["dst_score"] * len(score))


def service_message_edges(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Proto service -> message its file mentions."""
    return _references(nodes.where("kind = 'service'"), nodes.where("kind = 'message'"), lines, False)


def func_call_edges(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Function -> function of another file by name: the functions among the reference edges."""
    funcs = nodes.where("kind = 'func'")
    return _references(funcs, funcs, lines, True)


def decl_edges(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """All candidate links: references, co-location, service -> message. Written as pairs; ``best_links`` goes without."""
    found = decl_ref_edges(nodes, lines).unionByName(colocation_edges(nodes)).unionByName(service_message_edges(nodes, lines))
    return found.groupBy("service", "src", "dst").agg(F.max("dst_score").alias("dst_score"))


def _by_score():
    return F.desc(F.round("dst_score", 12)), F.asc("dst")


def _first(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The best ``n`` targets per key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*_by_score()))).where(F.col("_n") <= n).drop("_n")


def best_links(nodes: DataFrame, lines: DataFrame, out_cap: int = 5, least: int = 2, most: int = 20) -> DataFrame:
    """The best ``out_cap`` of ``decl_edges`` per source, with their ``place``, found without writing out its pairs.

    A node's id holds its file and name, so of a word's targets at most one lies in a given file, and all
    nodes of a file leave out the same targets but for those of their own name. Therefore ``out_cap`` + 1 targets per (service, word)
    are enough for any file; of those, the first 2 * ``out_cap`` + 1 of a file are enough for any of its nodes, whose own name
    takes away at most ``out_cap`` + 1. Only these are joined to the nodes, so rows are in proportion to words of files and to nodes.
    """
    named = nodes.select("service", "id", "file", "name", "kind", "score")
    to = named.where(F.octet_length("name") >= 5).select(
        "service", F.col("name").alias("word"), F.col("id").alias("dst"), F.col("file").alias("dst_file"), "kind", F.col("score").alias("dst_score")
    )
    to_any = _first(to.drop("kind").distinct(), ["service", "word"], out_cap + 1)
    to_message = _first(to.where("kind = 'message'").drop("kind").distinct(), ["service", "word"], out_cap)
    holders = named.select("service", "file").distinct()
    words = file_words(lines, 5).join(to.select("word").distinct(), "word", "left_semi")
    words = settle(words.withColumnRenamed("id", "file").join(holders, "file"), "holder-words")
    sources = named.select("service", "file", F.col("id").alias("src"), F.col("name").alias("src_name")).distinct()
    link = ["service", "src", "dst", "dst_score"]

    def mentioned(targets: DataFrame) -> DataFrame:
        return words.join(targets, ["service", "word"])

    refs = _first(mentioned(to_any).where("dst_file <> file"), ["service", "file"], 2 * out_cap + 1)
    refs = refs.join(sources, ["service", "file"]).where("word <> src_name").select(*link)
    with_services = sources.join(named.where("kind = 'service'").select(F.col("id").alias("src"), "service").distinct(), ["service", "src"], "left_semi")
    messages = _first(mentioned(to_message), ["service", "file"], out_cap).join(with_services, ["service", "file"]).select(*link)
    size = nodes.groupBy("service", "file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most)).drop("n")
    inside = named.join(size, ["service", "file"], "left_semi").select("service", "file", F.col("id").alias("dst"), F.col("name").alias("word"), F.col("score").alias("dst_score"))
    near = _first(inside.distinct(), ["service", "file"], out_cap + 1).join(sources, ["service", "file"]).where("word <> src_name").select(*link)
    found = refs.unionByName(messages).unionByName(near).groupBy("service", "src", "dst").agg(F.max("dst_score").alias("dst_score"))
    place = F.row_number().over(Window.partitionBy("service", "src").orderBy(*_by_score()))
    return found.withColumn("place", place).where(F.col("place") <= out_cap)


def cap_out_edges(nodes: DataFrame, best: DataFrame, per_node: int = 3, least: int = 10) -> DataFrame:
    """The first max(least, per_node * nodes) links per service, in the order of source and target, with their ``place_in_service``."""
    quota = nodes.groupBy("service").agg(F.greatest(F.lit(least), per_node * F.count(F.lit(1))).alias("quota"))
    placed = place_in_group(best.select("service", "src", "dst"), "service", ["src", "dst"], "place_in_service")
    return placed.join(quota, "service").where("place_in_service <= quota").drop("quota")


def drop_orphans(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that appear in a link."""
    ends = links.select("service", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, ["service", "id"], "left_semi")


def architecture_nodes(services: DataFrame, foreign: DataFrame, technologies: DataFrame, used: DataFrame) -> DataFrame:
    """Service, foreign-service and technology nodes.

    ``services``: service, line_count; ``foreign``: name, language, line_count; ``technologies``:
    technology; ``used``: service, technology.
    """
    own = services.select(
        F.concat(F.lit("ms:"), "service").alias("id"), F.col("service").alias("label"), F.lit("microservice").alias("kind"),
        (F.col("line_count") / 1000.0).alias("score"), F.lit("ms").alias("grp"),
    )
    other = foreign.select(
        F.concat(F.lit("ms:"), "name").alias("id"), F.col("name").alias("label"), F.lit("foreign").alias("kind"),
        (F.col("line_count") / 1000.0).alias("score"), F.lit("foreign").alias("grp"),
    )
    in_use = used.join(services.select("service"), "service", "left_semi").select("technology")
    in_use = in_use.unionByName(foreign.select(F.col("language").alias("technology"))).distinct()
    tech = technologies.join(in_use, "technology", "left_semi").where("technology <> 'Go'").select(
        F.concat(F.lit("tech:"), "technology").alias("id"), F.col("technology").alias("label"),
        F.lit("technology").alias("kind"), F.lit(3.0).alias("score"), F.lit("tech").alias("grp"),
    )
    return own.unionByName(other).unionByName(tech)


def architecture_links(services: DataFrame, foreign: DataFrame, used: DataFrame) -> DataFrame:
    """Service -> technology and foreign service -> language."""
    own = used.join(services.select("service"), "service", "left_semi").where("technology <> 'Go'").select(
        F.concat(F.lit("ms:"), "service").alias("src"), F.concat(F.lit("tech:"), "technology").alias("dst")
    )
    other = foreign.select(F.concat(F.lit("ms:"), "name").alias("src"), F.concat(F.lit("tech:"), "language").alias("dst"))
    return own.unionByName(other)
