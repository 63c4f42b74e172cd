"""The engine's inputs bound to one folder of tables."""

from __future__ import annotations

from functools import cache, cached_property
from threading import Lock, RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.operators import branches as br
from codequarry.operators import chains, declgraph, extract, graph, history, marts, services, technology
from codequarry.plans import standins
from codequarry.sources import files as src
from codequarry.sources import store

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


#: The JVM never compiles a method of more bytes than this. A view's choice among all templates is longer in one piece.
METHOD_BYTES = 8000
_written: dict[tuple, tuple] = {}
_lock, _locks = Lock(), {}


class Codebase:
    """Lazily built DataFrames. Stand-ins and results that several queries share are written when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """A stand-in view as a table: written once per session to the shared folder, then read like
        any ingested table, so its defining expressions stay out of the operators' plans."""
        return self.stage(f"view-{name}", lambda: self._view(name), METHOD_BYTES)

    def stage(self, name: str, build, method_bytes: int | None = None) -> DataFrame:
        """The result of ``build`` as a table, written once per session: what several queries share.

        ``method_bytes``: a stage whose generated method is larger runs as smaller ones.
        """
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        with _lock:
            own = _locks.setdefault(key, RLock())
        with own:  # another thread that needs the table waits for it
            if key not in _written:
                df = build()
                path = store.new_table_path(self.spark, name)
                with store.setting(self.spark, "spark.sql.codegen.hugeMethodLimit", method_bytes):
                    df.write.parquet(path)
                _written[key] = (path, df.schema)
        path, schema = _written[key]
        return self.spark.read.schema(schema).parquet(path)

    def _view(self, name: str) -> DataFrame:
        ctes: dict[str, str] = {}

        def need(v: str) -> None:
            deps, sql = standins.view_sql(v, "spark")
            for d in deps:
                need(d)
            for t in TABLES:
                sql = sql.replace("{" + t + "}", f"parquet.`{self.folder}/{t}.parquet`")
            ctes[v] = sql

        need(name)
        body = ctes.pop(name)
        head = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " " if ctes else ""
        return self.spark.sql(head + body)

    # source text -----------------------------------------------------------------------------
    @cached_property
    def lines(self) -> DataFrame:
        return self.view("code_lines").select("repo", "path", "line_no", "text")

    @cached_property
    def files(self) -> DataFrame:
        return self.view("code_files")

    def with_id(self, df: DataFrame) -> DataFrame:
        """Add ``id`` (absolute path) and the file's service."""
        side = self.files.select("repo", "path", "service")
        return df.join(side, ["repo", "path"]).withColumn("id", text.abs_path(F.col("repo"), F.col("path")))

    @cached_property
    def id_lines(self) -> DataFrame:
        return self.lines.select(text.abs_path(F.col("repo"), F.col("path")).alias("id"), "line_no", "text")

    @cached_property
    def declarations(self) -> DataFrame:
        pos = (F.col("line_no") * 4 + F.col("kind_ord")).alias("pos")
        return self.stage(
            "declarations",
            lambda: self.with_id(extract.declarations(self.lines)).select("id", "service", pos, "name", "kind"),
        )

    @cached_property
    def imports(self) -> DataFrame:
        return self.stage(
            "imports", lambda: self.with_id(extract.extract_imports(self.lines)).select("id", "service", "import")
        )

    @cached_property
    def parsed(self) -> DataFrame:
        return extract.parsed_files(self.files, self.lines, extents=self.extents).withColumn("id", text.abs_path(F.col("repo"), F.col("path")))

    @cached_property
    def sizes(self) -> DataFrame:
        """id, service, file_type, line_count, todo_count, fixme_count: the light part of parsed_files."""
        todo = self.stage("todo-counts", lambda: extract.todo_counts(self.lines))
        return self._sizes(todo, "todo_count", "fixme_count")

    @cached_property
    def line_sizes(self) -> DataFrame:
        """The same without the comments, which need a pass over the text."""
        return self._sizes()

    def _sizes(self, todo: DataFrame | None = None, *counts: str) -> DataFrame:
        count = self.stage("line-counts", lambda: self.lines.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("line_count")))
        rows = self.files.join(count, ["repo", "path"], "left")
        if todo is not None:
            rows = rows.join(todo, ["repo", "path"], "left")
        return rows.select(
            text.abs_path(F.col("repo"), F.col("path")).alias("id"),
            "service",
            text.extension(F.col("path")).alias("file_type"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("line_count", *counts)],
        )

    @cached_property
    def file_ids(self) -> DataFrame:
        """id, service, file_type, package."""
        package = extract.extract_package(self.lines)
        return self.files.join(package, ["repo", "path"], "left").select(
            text.abs_path(F.col("repo"), F.col("path")).alias("id"),
            "service",
            text.extension(F.col("path")).alias("file_type"),
            F.coalesce("package", F.lit("")).alias("package"),
        )

    @cached_property
    def extents(self) -> DataFrame:
        return self.stage("extents", lambda: extract.function_extents(self.lines))

    # listing -----------------------------------------------------------------------------------
    @cached_property
    def listing(self) -> DataFrame:
        return self.view("listing")

    @cached_property
    def tree(self) -> DataFrame:
        return self.stage("tree", lambda: src.directory_tree(self.listing))

    @cached_property
    def services(self) -> DataFrame:
        return self.stage("services", lambda: services.discover_services(self.tree))

    @cached_property
    def source_files(self) -> DataFrame:
        return self.stage("source-files", self.new_source_files)

    def new_source_files(self) -> DataFrame:
        return services.assign_service(src.scan_source_files(self.listing), self.services, self.tree)

    @cached_property
    def foreign(self) -> DataFrame:
        return self.stage("foreign", self.new_foreign)

    def new_foreign(self) -> DataFrame:
        return services.foreign_services(src.prune_dirs(self.listing), self.services, self.source_files)

    @cached_property
    def manifest_lines(self) -> DataFrame:
        return self.view("manifest_lines")

    @cached_property
    def technologies(self) -> DataFrame:
        return technology.technology_list(
            technology.manifest_technologies(self.manifest_lines),
            self.files.select(text.extension(F.col("path")).alias("file_type")),
            self.imports,
            self.foreign,
        )

    # graph ---------------------------------------------------------------------------------------
    @cached_property
    def vertices(self) -> DataFrame:
        return graph.vertices(self.file_ids)

    @cached_property
    def link_graph(self) -> graph.Links:
        """Imports and type references; what many files share stays in classes."""
        found = cache(lambda: graph.link_graph(
            self.vertices,
            graph.ref_links(self.file_ids, self.id_lines, self.declarations),
            graph.import_edges(self.file_ids, self.imports),
        ))
        return graph.Links(*(self.stage(f"links-{part}", lambda part=part: getattr(found(), part)) for part in ("single", "classes", "joined")))

    @cached_property
    def links(self) -> DataFrame:
        """Links of the web pages: page -> linked path."""
        hrefs = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
        return self.table("pages").select(F.concat(F.lit("/p"), F.col("page_id").cast("string")).alias("src"), F.explode(hrefs).alias("dst"))

    @cached_property
    def scores(self) -> DataFrame:
        """PageRank of the files."""
        return self.stage("scores", lambda: graph.pagerank(self.vertices, self.link_graph))

    # history -------------------------------------------------------------------------------------
    @cached_property
    def commits(self) -> DataFrame:
        rows = self.view("commits")
        return rows.withColumn("parents", F.array_compact(F.array("parent1", "parent2"))).drop("parent1", "parent2")

    @cached_property
    def commit_files(self) -> DataFrame:
        return self.view("commit_files")

    @cached_property
    def touches(self) -> DataFrame:
        return history.file_touches(self.commits, self.commit_files)

    @cached_property
    def repos(self) -> DataFrame:
        return self.commits.select("repo", "repo_ord").distinct()

    @cached_property
    def branches(self) -> DataFrame:
        return self.view("branches").join(self.view("tips"), "repo", "left")

    @cached_property
    def authors(self) -> DataFrame:
        return history.author_stats(self.commits)

    @cached_property
    def numstat(self) -> DataFrame:
        side = self.commits.select("repo", "hash", "author")
        return self.commit_files.join(side, ["repo", "hash"]).select("author", "added")

    @cached_property
    def file_authors(self) -> DataFrame:
        """The touches counted by file and author, with the lines added: commits and their files are joined once for both."""
        return self.stage("file-authors", lambda: history.file_authors(self.commits, self.commit_files))

    @cached_property
    def modified(self) -> DataFrame:
        ids = self.files.select(text.abs_path(F.col("repo"), F.col("path")).alias("id"), "service")
        tops = history.top_authors_per_file(self.file_authors)
        enriched = history.enrich_files(ids, tops, self.repos).where("top_authors IS NOT NULL")
        return history.author_files_modified(enriched, self.authors)

    @cached_property
    def chains(self) -> chains.ChainIndex:
        """The commit graph's chains: one index for main commits and all merges."""
        edges = self.stage("chain-edges", lambda: chains.chain_edges(self.commits))
        tails = self.stage("chain-tails", lambda: chains.chain_tails(edges))
        links = self.stage("chain-links", lambda: chains.chain_links(edges, tails))
        return chains.ChainIndex(edges, tails, links, chains.named(self.commits, edges))

    @cached_property
    def merge_chains(self) -> chains.ChainIndex:
        """The same with its members written: merges look up many hashes."""
        return self.chains._replace(members=self.stage("chain-members", lambda: self.chains.members))

    @cached_property
    def main_numbers(self) -> DataFrame:
        return self.stage("main-numbers", lambda: br.main_numbers(self.commits, self.branches, self.chains))

    @property
    def on_main(self) -> DataFrame:
        return br.of_numbers(self.commits, self.main_numbers)

    @cached_property
    def merges(self) -> DataFrame:
        return self.stage("merges", lambda: br.newest_merges(self.on_main))

    # declaration graph ---------------------------------------------------------------------------
    @cached_property
    def big_functions(self) -> DataFrame:
        big = self.with_id(extract.big_functions(self.extents))
        return big.select("id", "service", (F.col("start_line") * 4).alias("pos"), "name")

    def new_nodes(self) -> DataFrame:
        return declgraph.decl_nodes(self.declarations, self.big_functions, self.scores)

    @cached_property
    def names(self) -> DataFrame:
        """The nodes without scores: links that nobody ranks need no PageRank."""
        return self.stage("node-names", lambda: declgraph.decl_names(self.declarations, self.big_functions))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.stage("nodes", self.new_nodes)

    # marts ---------------------------------------------------------------------------------------
    @cached_property
    def summary(self) -> DataFrame:
        return marts.service_summary(self.line_sizes, self.declarations)
