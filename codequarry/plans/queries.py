"""Every operator as a named query over a folder of tables; arrays are joined to text in the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import scan, text
from codequarry.operators import branches as br
from codequarry.operators import declgraph as dg
from codequarry.operators import extract, graph, history, marts, rules, services
from codequarry.operators import technology as tech
from codequarry.plans import standins
from codequarry.plans.codebase import Codebase
from codequarry.sources import files as src
from codequarry.sources import history_text as ht
from codequarry.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Callable[[Codebase], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Codebase(spark, folder))
        return fn

    return register


def big(*cols: str):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


def joined(col: str, alias: str | None = None):
    return F.array_join(col, ",").alias(alias or col)


def r6(col: str):
    return F.round(F.col(col), 6).alias(col)


# sources ---------------------------------------------------------------------------------------
query("scan_source_files")(lambda c: src.scan_source_files(c.listing).select("path"))
query("prune_dirs")(lambda c: src.prune_dirs(c.listing).select("path"))
query("scan_manifests")(lambda c: src.scan_manifests(c.listing).select("path"))
query("directory_tree")(lambda c: src.directory_tree(c.listing))
query("root_subdirs")(lambda c: src.root_subdirs(c.tree))
query("list_repos")(lambda c: src.list_repos(c.tree, c.services).select("path", *big("priority")))


@query("ingest_commit_log")
def _commit_log(c: Codebase) -> DataFrame:
    paths = c.commit_files.groupBy("repo", "hash").agg(F.array_join(F.collect_list("path"), "\n").alias("paths"))
    dump = c.commits.join(paths, ["repo", "hash"], "left").select(
        "repo",
        F.concat_ws("\n", "author", F.col("ts").cast("string"), "subject", F.lit(""), "paths", F.lit("")).alias("block"),
    )
    rows = ht.ingest_commit_log(dump)
    return rows.select("repo", "author", F.col("ts").cast("bigint").alias("ts"), "subject", "path")


@query("ingest_commits")
def _commit_records(c: Codebase) -> DataFrame:
    """The log written as record exports, one folder per repository, and read back from their bytes."""
    paths = c.commit_files.groupBy("repo", "hash").agg(F.array_join(F.collect_list("path"), "\n").alias("paths"))
    head = F.concat_ws("\x1f", "hash", F.array_join("parents", " "), "author", F.col("ts").cast("string"), "message")
    dump = c.commits.join(paths, ["repo", "hash"], "left").select(
        "repo", "log_seq", F.concat(head, F.lit("\x1d\n\n"), F.coalesce("paths", F.lit("")), F.lit("\n")).alias("block")
    )
    folder = ht.write_exports(dump, "log_seq", store.new_table_path(c.spark, "log-export"), ht.RECORD_MARK)
    rows = ht.ingest_commits(ht.read_exports(c.spark, folder, ht.RECORD_MARK))
    return rows.select("repo", "hash", joined("parents"), "author", *big("ts"), "subject", "message", *big("log_seq"), joined(F.array_sort("paths"), "paths"))


@query("ingest_heads")
def _heads(c: Codebase) -> DataFrame:
    """Heads written as one export per repository and read back; the branch first by name has the mark, each has a tip of its own."""
    rows = c.view("branches")
    least = rows.groupBy("repo").agg(F.min("name").alias("least"))
    mark = F.when(F.col("name") == F.col("least"), "*").otherwise(" ")
    dump = rows.join(least, "repo").select("repo", "name", F.concat_ws("\t", mark, "name", F.col("ts").cast("string"), F.md5(F.concat_ws("/", "repo", "name"))).alias("block"))
    folder = ht.write_exports(dump, "name", store.new_table_path(c.spark, "heads-export"), "\n")
    lines = ht.read_exports(c.spark, folder, "\n").select("repo", F.col("block").alias("text"))
    return ht.ingest_heads(lines).select("repo", "name", *big("ts"), "tip", "is_head")


@query("ingest_numstat")
def _numstat(c: Codebase) -> DataFrame:
    stat = F.concat(F.coalesce(F.col("added").cast("string"), F.lit("-")), F.lit("\t3\t"), F.col("path"))
    lines = c.commit_files.groupBy("repo", "hash").agg(F.array_join(F.collect_list(stat), "\n").alias("stats"))
    dump = lines.join(c.commits.select("repo", "hash", "author"), ["repo", "hash"]).select(
        F.concat_ws("\n", "author", "stats", F.lit("")).alias("block")
    )
    return ht.ingest_numstat(dump).groupBy("author", "path").agg(F.sum("added").cast("bigint").alias("added"))


def _blame_dump(c: Codebase, chunk_rows: int | None) -> DataFrame:
    """Porcelain text of the code lines: the author's name only at a commit's first line of a file."""
    rows = c.view("code_lines").select("repo", "path", "blame_hash", "line_no", "text")
    if chunk_rows is None:  # files that fit into a task are shuffled once, by file, for the dump and for its reader
        rows = scan.dealt(rows, ["repo", "path"], rows.count())
        rows = rows.withColumn("first_line", F.min("line_no").over(Window.partitionBy("repo", "path", "blame_hash")))
    else:
        first = rows.groupBy("repo", "path", "blame_hash").agg(F.min("line_no").alias("first_line"))
        rows = rows.join(first, ["repo", "path", "blame_hash"])
    no = F.col("line_no").cast("string")
    name = F.concat(F.lit("author by-"), F.regexp_replace("blame_hash", "^0+", ""))
    out = F.array(
        F.struct(F.lit(0).alias("k"), F.concat_ws(" ", "blame_hash", no, no, F.lit("1")).alias("text")),
        F.struct(F.lit(1).alias("k"), F.when(F.col("line_no") == F.col("first_line"), name).otherwise("").alias("text")),
        F.struct(F.lit(2).alias("k"), F.concat(F.lit("\t"), F.col("text")).alias("text")),
    )
    return rows.select("repo", "path", "line_no", F.inline(out)).select(
        "repo", "path", (F.col("line_no") * 3 + F.col("k")).cast("bigint").alias("seq"), "text"
    )


@query("ingest_blame")
def _blame(c: Codebase) -> DataFrame:
    last = c.view("code_lines").select((F.col("line_no") * 3 + 2).alias("seq"))  # measured without making the dump
    chunk_rows = scan.fit_chunks(last, "seq")
    return ht.ingest_blame(_blame_dump(c, chunk_rows), chunk_rows).select("repo", "path", *big("line_no"), "author")


@query("ingest_refs")
def _refs(c: Codebase) -> DataFrame:
    dump = c.view("branches").select(
        "repo", F.concat(F.lit(" "), F.col("name"), F.lit("\t"), F.col("ts").cast("string")).alias("text")
    )
    names = c.view("tags").select("repo", F.concat(F.col("tag"), F.lit(" \r")).alias("text"))
    branch = ht.ingest_branches(dump).select("repo", F.lit("branch").alias("kind"), "name", "ts")
    tag = ht.ingest_tags(names).select("repo", F.lit("tag").alias("kind"), F.col("tag").alias("name"), F.lit(0).cast("bigint").alias("ts"))
    return branch.unionByName(tag)


@query("write_marts")
def _write(c: Codebase) -> DataFrame:
    path = store.new_table_path(c.spark, "mart-author-stats")
    store.write_mart(c.authors, path, "2024-01-01")
    rows = c.spark.read.parquet(path)
    return rows.select("author", *big("total_commits", "first_commit", "last_commit"), F.col("run_date").cast("string").alias("run_date"))


# services --------------------------------------------------------------------------------------
query("service_dirs")(lambda c: services.service_dirs(c.tree))
query("discover_services")(lambda c: services.discover_services(c.tree).select("path"))
query("services_root")(lambda c: services.services_root(c.services))
query("assign_service")(lambda c: c.new_source_files().select("path", "service"))
query("files_by_service")(lambda c: services.files_by_service(c.source_files))
query("foreign_services")(lambda c: c.new_foreign().select("name", "language", "service_path", *big("line_count", "file_count")))


# extraction ------------------------------------------------------------------------------------
@query("explode_lines")
def _lines(c: Codebase) -> DataFrame:
    docs = c.table("documents").select("lang", F.col("doc_id").cast("string").alias("path"), "text")
    docs = docs.select(F.col("lang").alias("repo"), "path", F.concat("text", F.lit("\r\nlast\n")).alias("content"))
    both = [extract.explode_lines(docs, f).withColumn("flavour", F.lit(f)) for f in ("scan", "split")]
    return both[0].unionByName(both[1]).select("flavour", "repo", "path", *big("line_no"), "text")


FILE = extract.FILE
query("extract_package")(lambda c: extract.extract_package(c.lines))
query("extract_imports")(lambda c: extract.extract_imports(c.lines).select(*FILE, *big("line_no"), "import"))
query("extract_types")(lambda c: extract.extract_types(c.lines).select(*FILE, *big("line_no"), "name", "kind"))
query("extract_funcs")(lambda c: extract.extract_funcs(c.lines).select(*FILE, *big("line_no"), "name"))
query("extract_description")(lambda c: extract.extract_description(c.lines))
query("todo_counts")(lambda c: extract.todo_counts(c.lines).select(*FILE, *big("todo_count", "fixme_count")))
query("function_extents")(lambda c: c.extents.select(*FILE, "name", *big("start_line", "end_line", "line_count")))
query("longest_function_per_file")(
    lambda c: extract.longest_function_per_file(c.extents).select(*FILE, "name", *big("start_line", "line_count"))
)
query("big_functions")(lambda c: extract.big_functions(c.extents).select(*FILE, "name", *big("start_line", "line_count")))
query("extract_proto")(lambda c: extract.extract_proto(c.lines).select(*FILE, *big("line_no", "kind_ord"), "name", "kind"))


@query("parsed_files")
def _parsed(c: Codebase) -> DataFrame:
    decls = F.array_join(F.transform("declarations", lambda d: F.concat_ws(" ", d["kind"], d["name"])), ",")
    bigs = F.array_join(F.transform("big_functions", lambda f: F.concat_ws(" ", f["name"], f["line_count"].cast("string"))), ",")
    return c.parsed.select(
        *FILE, "service", "file_type", *big("line_count"), "package", "description", *big("todo_count", "fixme_count"),
        joined("imports"), decls.alias("declarations"), F.col("longest_function.name").alias("longest_name"),
        F.col("longest_function.line_count").cast("bigint").alias("longest_lines"), bigs.alias("big_functions"),
    )


# technologies ----------------------------------------------------------------------------------
query("tech_from_imports")(lambda c: tech.tech_from_imports(c.imports))
query("tech_from_gomod")(lambda c: tech.tech_from_gomod(c.manifest_lines))
query("tech_from_makefile")(lambda c: tech.tech_from_makefile(c.manifest_lines))
query("compose_services")(lambda c: tech.compose_services(c.manifest_lines))
query("tech_from_images")(lambda c: tech.tech_from_images(c.manifest_lines))
query("tech_from_env_ports")(lambda c: tech.tech_from_env_ports(c.manifest_lines))
query("manifest_technologies")(lambda c: tech.manifest_technologies(c.manifest_lines))
query("technology_list")(lambda c: c.technologies)


@query("components")
def _components(c: Codebase) -> DataFrame:
    kinds = c.declarations.agg(
        F.count_if(F.col("kind") == "service").alias("services"), F.count_if(F.col("kind") == "rpc").alias("rpcs")
    )
    ids = c.files.select(text.abs_path(F.col("repo"), F.col("path")).alias("id"), text.extension(F.col("path")).alias("file_type"))
    tests = marts.layer_of_file(ids).agg(F.count_if(F.col("layer") == "Tests").alias("test_files"))
    return tech.components(c.technologies, kinds.crossJoin(tests)).select(*big("component_ord"), "component", "summary")


def _service_tech(c: Codebase) -> DataFrame:
    kinds = c.files.select("service", text.extension(F.col("path")).alias("file_type"))
    return tech.service_technologies(kinds, c.imports)


query("service_technologies")(_service_tech)

# graph -----------------------------------------------------------------------------------------
query("vertices")(lambda c: c.vertices)
query("name_map")(lambda c: graph.name_map(c.file_ids).select("name", "id"))
query("import_edges")(lambda c: graph.import_edges(c.file_ids, c.imports))
query("type_ref_edges")(lambda c: graph.type_ref_edges(c.file_ids, c.id_lines, c.declarations))


@query("type_ref_words")
def _words(c: Codebase) -> DataFrame:
    docs = c.table("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "text")
    names = c.table("benchmark").select(F.explode(text.words(F.col("text"))).alias("word")).where("length(word) >= 3").distinct()
    return graph.token_overlap(docs, names)


query("edges")(lambda c: c.link_graph.pairs())
query("degrees")(lambda c: graph.degrees(c.vertices, c.link_graph).select("id", *big("out_degree", "in_degree")))


def _link_graph(c: Codebase) -> tuple[DataFrame, DataFrame]:
    ends = c.links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends, graph.edges(ends, c.links)


@query("page_link_degrees")
def _link_degrees(c: Codebase) -> DataFrame:
    vertex, edge = _link_graph(c)
    return graph.degrees(vertex, edge).select("id", *big("out_degree", "in_degree"))


@query("pagerank")
def _pagerank(c: Codebase) -> DataFrame:
    return graph.pagerank(c.vertices, c.link_graph).select("id", F.round("score", 9).alias("score"))


@query("top_hotspots")
def _hotspots(c: Codebase) -> DataFrame:
    best = graph.top_hotspots(c.scores, 30)
    return best.select("id", F.round("score", 9).alias("score"))


@query("hot_zones")
def _hot_zones(c: Codebase) -> DataFrame:
    counts = c.declarations.groupBy("id").agg(F.count(F.lit(1)).alias("declaration_count"))
    files = c.line_sizes.select("id", "service", "line_count").join(counts, "id", "left")
    rows = graph.hot_zones(c.scores, files)
    return rows.select("id", "display_dir", "display_file", F.round("score", 9).alias("score"),
                       *big("line_count", "declaration_count"), "service")


query("decl_nodes")(lambda c: c.new_nodes().select("service", "id", "name", "kind", r6("score")))
_L = ["service", "src", "dst"]
query("decl_ref_edges")(lambda c: dg.decl_ref_edges(c.names, c.id_lines).select(*_L))
query("colocation_edges")(lambda c: dg.colocation_edges(c.names).select(*_L))
query("colocation_groups")(lambda c: dg.colocation_groups(c.names))
query("service_message_edges")(lambda c: dg.service_message_edges(c.names, c.id_lines).select(*_L))
query("func_call_edges")(lambda c: dg.func_call_edges(c.names, c.id_lines).select(*_L))


def _kept(c: Codebase) -> tuple[DataFrame, DataFrame]:
    return c.nodes, dg.cap_out_edges(c.nodes, dg.best_links(c.nodes, c.id_lines)).select(*_L)


query("cap_out_edges")(lambda c: _kept(c)[1])


@query("drop_orphans")
def _orphans(c: Codebase) -> DataFrame:
    nodes, links = _kept(c)
    return dg.drop_orphans(nodes, links).select("service", "id", "kind")


@query("architecture_graph")
def _architecture(c: Codebase) -> DataFrame:
    own, used = marts.service_summary(c.line_sizes, c.declarations), _service_tech(c)
    own = own.select("service", F.col("total_lines").alias("line_count"))
    nodes = dg.architecture_nodes(own, c.foreign, c.technologies, used)
    links = dg.architecture_links(own, c.foreign, used)
    return nodes.select(F.lit("node").alias("part"), "id", "label", "kind", r6("score"), F.lit("").alias("target")).unionByName(
        links.select(F.lit("link").alias("part"), F.col("src").alias("id"), F.lit("").alias("label"), F.lit("").alias("kind"),
                     F.lit(0.0).alias("score"), F.col("dst").alias("target"))
    )


# history ---------------------------------------------------------------------------------------
query("latest_commits")(lambda c: history.latest_commits(c.commits).select("repo", "hash", *big("log_seq")))
query("author_stats")(lambda c: c.authors.select("author", *big("total_commits", "first_commit", "last_commit")))
query("file_stats")(
    lambda c: history.file_stats(c.touches).select("repo", "path", *big("change_count", "last_modified", "first_commit_date"))
)
query("top_authors_per_file")(lambda c: history.top_authors_per_file(c.touches).select("repo", "path", joined("top_authors")))
query("recent_messages")(
    lambda c: history.recent_messages(c.touches).select("repo", "path", F.array_join("recent_messages", "|").alias("recent_messages"))
)


@query("enrich_files")
def _enrich(c: Codebase) -> DataFrame:
    ids = c.files.select(text.abs_path(F.col("repo"), F.col("path")).alias("id"), "service")
    rows = history.enrich_files(ids, history.file_history(c.touches), c.repos)
    return rows.select(
        "id", "service", *big("change_count", "last_modified", "first_commit_date"), joined("top_authors"),
        F.array_join("recent_messages", "|").alias("recent_messages"),
    )


query("author_files_modified")(lambda c: c.modified.select("author", "service", *big("files_modified")))
query("author_loc")(lambda c: history.author_loc(c.numstat, c.authors))
query("churn")(lambda c: history.churn(c.file_authors, 50).select("path", *big("change_count"), joined("top_authors")))
query("tag_stats")(lambda c: history.tag_stats(c.view("tags")))
query("latest_semver")(lambda c: history.latest_semver(c.view("tags")))
query("classify_commits")(lambda c: history.classify_commits(c.commits).select("hash", "commit_type"))
query("commit_stats")(lambda c: history.commit_stats(history.classify_commits(c.commits)))
query("commit_type_counts")(lambda c: history.commit_type_counts(history.classify_commits(c.commits)))
query("nonstandard_samples")(
    lambda c: history.nonstandard_samples(history.classify_commits(c.commits)).select(*big("repo_ord", "log_seq"), "hash", "subject")
)


def _line_authors(c: Codebase) -> DataFrame:
    blame = c.view("blame_claims").groupBy("repo", "path", "line_no").agg(F.min("author").alias("author"))  # the first by name of several
    repos = c.spark.createDataFrame(list(standins.BLAME_REPOS), "repo string, repo_ord int")
    return ht.line_authors(blame, repos, blame.select("path"))


query("line_authors")(lambda c: _line_authors(c).select("path", *big("line_no"), "author"))
query("default_branch")(lambda c: br.default_branch(c.branches))
query("branch_inventory")(lambda c: br.branch_inventory(c.branches).select("name", "repo", *big("ts", "depth")))
query("stale_branches")(
    lambda c: br.stale_branches(br.branch_inventory(c.branches), standins.NOW).select("name", *big("last_activity", "days_inactive"))
)
query("merge_commit_ranges")(
    lambda c: br.merge_commit_ranges(c.commits, c.merges, c.merge_chains).select("repo", "merge", "hash", *big("ts"))
)


def _durations(c: Codebase) -> DataFrame:
    return br.branch_durations(br.merge_commit_ranges(c.commits, c.merges, c.merge_chains), c.merges)


query("branch_durations")(lambda c: _durations(c).select(*[r6(x) for x in ("avg_lifetime_days", "avg_merge_days", "avg_delay_hours")]))
query("rollback_rate")(lambda c: br.rollback_rate(c.commits, c.main_numbers).select(*big("rollbacks", "main_commits"), F.col("rollback_pct").cast("double").alias("rollback_pct")))
query("peak_commit_day")(lambda c: br.peak_commit_day(c.commits).select("peak_day", *big("commits")))
query("main_commit_count")(lambda c: br.main_commit_count(c.main_numbers))

# rules -----------------------------------------------------------------------------------------
for _r in rules.RULES:
    query(_r.key)(
        lambda c, key=_r.key: rules.all_hits(c.lines, (key,)).select(*FILE, *big("line_no", "trigger_line"), "snippet")
    )


@query("run_rules")
def _run_rules(c: Codebase) -> DataFrame:
    return rules.run_rules(c.lines).select("rule", "display_path", *big("line_no"), "snippet")


@query("violation_authors")
def _violation_authors(c: Codebase) -> DataFrame:
    authors = c.view("code_lines").select(*FILE, "line_no", "author")
    rows = rules.violation_authors(rules.run_rules(c.lines), authors)
    return rows.select("rule", *FILE, *big("line_no"), "author")


query("rule_summary")(
    lambda c: rules.rule_summary(rules.run_rules(c.lines)).select(*big("rule_ord"), "rule", "priority", *big("violations"), "passed")
)

# report tables ---------------------------------------------------------------------------------
_KIND_COLS = list(marts.KINDS)
query("totals")(
    lambda c: marts.totals(c.sizes, c.declarations, c.foreign).select(
        *big("total_lines", "go_files", "proto_files", "todos", "fixmes", *_KIND_COLS, "declarations", "service_count")
    )
)
query("service_summary")(lambda c: c.summary.select("service", *big("files", "total_lines", "declarations", *_KIND_COLS)))
query("service_order")(lambda c: marts.service_order(c.summary).select("service", *big("total_lines", "place"), "is_gateway", "is_proto"))
query("foreign_language_lines")(lambda c: marts.foreign_language_lines(c.foreign))
query("layer_of_file")(
    lambda c: marts.layer_of_file(
        c.files.select(text.abs_path(F.col("repo"), F.col("path")).alias("id"), text.extension(F.col("path")).alias("file_type"))
    ).select("id", "layer")
)
query("layer_rollup")(lambda c: marts.layer_rollup(c.line_sizes).select(*big("layer_ord"), "layer", *big("files", "lines", "pct")))
query("service_penetration")(
    lambda c: marts.service_penetration(c.files, c.imports).select("target", *big("dependents"), joined("importers"))
)
query("todo_density")(lambda c: marts.todo_density(c.sizes))


@query("longest_functions")
def _longest(c: Codebase) -> DataFrame:
    best = extract.longest_function_per_file(c.extents).withColumn("id", text.abs_path(F.col("repo"), F.col("path")))
    return marts.longest_functions(best).select("id", "name", *big("line_count"))


query("file_inventory")(
    lambda c: marts.file_inventory(c.parsed).select(
        "service", "id", "file_name", *big("line_count", "declaration_count"), "declaration_list", "description", "whole_description", "type_tag"
    )
)
query("team_map")(
    lambda c: marts.team_map(c.authors, c.modified, history.author_loc(c.file_authors, c.authors)).select(
        "author", *big("files_modified", "total_commits", "loc_per_commit"), "first_date", "last_date", joined("top_services")
    )
)
query("churn_display")(lambda c: marts.churn_display(history.churn(c.file_authors, 50)).select("path", "display_path", *big("change_count")))


@query("semantic_standards")
def _standards(c: Codebase) -> DataFrame:
    tags = c.view("tags")
    return marts.semantic_standards(
        history.tag_stats(tags), history.latest_semver(tags), history.commit_stats(history.classify_commits(c.commits))
    )


@query("branch_health")
def _health(c: Codebase) -> DataFrame:
    inv = br.branch_inventory(c.branches)
    rows = marts.branch_health(
        inv,
        br.stale_branches(inv, standins.NOW),
        _durations(c),
        br.rollback_rate(c.commits, c.main_numbers),
        br.peak_commit_day(c.commits),
    )
    return rows.select(
        *big("total_branches", "max_depth", "stale_branches"), *[r6(x) for x in ("avg_lifetime_days", "avg_merge_days", "avg_delay_hours")],
        *big("rollbacks", "main_commits"), F.col("rollback_pct").cast("double").alias("rollback_pct"), "peak_day",
    )


query("service_grid")(lambda c: marts.service_grid(c.summary, c.foreign))

#: The report's tables.
MARTS = (
    "totals", "service_summary", "service_order", "foreign_language_lines", "layer_of_file", "layer_rollup", "service_penetration", "todo_density",
    "longest_functions", "file_inventory", "team_map", "churn_display", "semantic_standards", "branch_health", "service_grid",
)


@query("write_all_marts")
def _write_all(c: Codebase) -> DataFrame:
    """Write every mart under its run date; the result is what a reader of the written tables finds: rows per mart."""
    # from the last: the walk over merges is long and leaves cores idle, so it starts early and others run beside it
    tables = {name: lambda name=name: QUERIES[name](c.spark, c.folder) for name in reversed(MARTS)}
    paths = store.write_marts(tables, store.new_table_path(c.spark, "marts"), "2024-01-01")
    counts = [
        c.spark.read.parquet(path).groupBy(F.lit(name).alias("mart"), F.col("run_date").cast("string").alias("run_date")).agg(F.count(F.lit(1)).alias("rows"))
        for name, path in paths.items()
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out
