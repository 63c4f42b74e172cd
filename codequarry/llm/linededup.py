"""Removal of repeated runs of lines, by winnowing over line hashes. DataFrame code only.

A run is a sequence of lines with at least ``MIN_WORDS`` words. A window is the shortest stretch of lines that
reaches that many words from a given first line (or up to a given last line); so every run consists of whole
windows, and a run that occurs twice has the same windows both times. Steps:

1. Winnow: the least line hash of each window is its fingerprint. Equal windows have equal fingerprints, so a
   repeated run is sure to share one. Windows whose fingerprint occurs at one position only are dropped.
2. Join positions: the rest meet by their whole content, and the first occurrence in document order is found.
3. Extend both ways: windows are tested from each first line forward and from each last line backward, so a
   match grows to the left and to the right line by line as far as any earlier text goes on alike.
4. Delete: lines in a window that occurred before go; the first occurrence of each run stays.

No pairs of occurrences are formed: an occurrence meets one row, the first of its kind, so a passage in a
third of all documents costs a row for each of its occurrences. Aggregates combine before their shuffles, and
joins on a frequent window are plain equi-joins, which adaptive execution splits.

A line of at least ``short_words`` words is a window by itself too, so hot lines below ``MIN_WORDS`` go whatever stands
beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.mixing import word_count
from codequarry.sources.store import settle

MIN_WORDS = 10
SHORT_WORDS = 3  # a line of one or two words ('Les.', 'Read more') is no passage by itself
_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _text_hash(text):
    """With the id, tells documents apart; rows alike in both are treated as one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, short_words: int | None = SHORT_WORDS) -> DataFrame:
    """``doc_id, text`` to ``doc_id, hash, lines``: for each document with deletions, the numbers (from 0) of its deleted lines.

    Lines are compared without outer white space; lines without words are passed over, but go if they lie
    within a deleted run. Documents are ordered by id (null first), then by the hash of their text. Whole
    lines from ``short_words`` words (None: none) up to ``min_words`` are windows too.
    """
    bare = F.transform(F.split(F.col("text"), "\n", -1), lambda s: F.regexp_replace(s, _TRIM, ""))
    facts = F.transform("_bare", lambda s, i: F.struct(i.alias("pos"), F.xxhash64(s).alias("hash"), F.xxhash64(F.lit(1), s).alias("more"), word_count(s).cast("int").alias("words")))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", _text_hash(F.col("text")).alias("_text"), bare.alias("_bare"))
    rows = rows.select("doc_id", "_text", F.filter(facts, lambda x: x["words"] > 0).alias("_lines"))
    rows = rows.groupBy("doc_id", "_text").agg(F.first("_lines").alias("_lines"))
    line = rows.select("doc_id", "_text", F.inline("_lines"))

    document = Window.partitionBy("doc_id", "_text")
    line = line.withColumn("end", F.sum("words").over(document.orderBy("pos")))
    line = line.withColumn("begin", F.col("end") - F.col("words")).withColumn("total", F.sum("words").over(document))
    ahead = document.orderBy("begin").rangeBetween(0, min_words - 1)
    back = document.orderBy("end").rangeBetween(-(min_words - 1), 0)

    def window(name: str, frame):
        content = F.collect_list(F.struct("hash", "more")).over(frame)
        return F.struct(F.lit(name).alias("way"), F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"), F.min(F.struct("hash", "pos")).over(frame).alias("least"), content.alias("content"))

    whole_ahead = F.when(F.col("total") - F.col("begin") >= min_words, window("ahead", ahead))
    # a line that is long enough by itself is one window, not two
    whole_back = F.when((F.col("end") >= min_words) & (F.col("words") < min_words), window("back", back))
    kinds = [whole_ahead.alias("ahead"), whole_back.alias("back")]
    if short_words is not None:
        alone = F.array(F.struct("hash", "more"))
        single = F.struct(F.lit("line").alias("way"), F.col("pos").alias("first"), F.col("pos").alias("last"), F.struct("hash", "pos").alias("least"), alone.alias("content"))
        kinds.append(F.when((F.col("words") >= short_words) & (F.col("words") < min_words), single).alias("single"))
    windows = line.select("doc_id", "_text", *kinds)
    windows = windows.select("doc_id", "_text", F.explode(F.array(*windows.columns[2:])).alias("w")).where("w is not null")
    windows = windows.select(
        "doc_id", "_text", "w.first", "w.last", F.col("w.least.hash").alias("print"), F.col("w.least.pos").alias("print_pos"),
        F.xxhash64("w.way", "w.content").alias("same"), F.xxhash64(F.lit(1), "w.way", "w.content").alias("same_too"),
    )
    windows = settle(windows, "windows")

    place = F.struct("doc_id", "_text", "print_pos")
    prints = windows.groupBy("print").agg(F.min(place).alias("_low"), F.max(place).alias("_high")).where("_low <> _high")
    shared = windows.join(prints.select("print"), "print", "left_semi")
    content, at = ["same", "same_too"], F.struct("doc_id", "_text", "first")
    origin = shared.groupBy(*content).agg(F.min(at).alias("_origin"), F.count(F.lit(1)).alias("_times")).where("_times > 1").drop("_times")
    later = shared.join(origin, content).where(at != F.col("_origin"))
    gone = later.select("doc_id", "_text", F.explode(F.sequence("first", "last")).alias("pos"))
    return gone.groupBy("doc_id", F.col("_text").alias("hash")).agg(F.array_sort(F.collect_set("pos")).alias("lines"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, short_words: int | None = SHORT_WORDS) -> DataFrame:
    """All columns and rows of ``docs`` with later repeated runs deleted from ``text``, and ``n_chars`` (if there) set anew.

    Null and empty texts stay as they are, and so do all documents without deletions, byte for byte. A document
    whose lines are all deleted stays with an empty text. Rows with equal id and text are one document and
    get the same result. Columns of any other name are carried along.
    """
    packed = docs.select(F.struct("*").alias("_row"))
    gone = repeated_lines(docs.select("doc_id", "text"), min_words, short_words)
    both = packed.join(gone, F.col("_row.doc_id").eqNullSafe(F.col("doc_id")) & (_text_hash(F.col("_row.text")) == F.col("hash")), "left")
    # maps of line numbers keep the filter linear in the number of lines
    hit = F.map_from_arrays("lines", F.transform("lines", lambda _: F.lit(True)))
    kept = F.filter(F.split("_row.text", "\n", -1), lambda s, i: F.try_element_at(F.col("_hit"), i).isNull())
    both = both.withColumn("_hit", hit)
    text = F.when(F.col("lines").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    both = both.select("_row", text.alias("_text"))
    columns = []
    for name in docs.columns:
        value = F.col(f"_row.`{name}`")
        if name == "text":
            value = F.col("_text")
        elif name == "n_chars":
            value = F.coalesce(F.char_length("_text").cast(docs.schema[name].dataType), value)
        columns.append(value.alias(name))
    return both.select(*columns)


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs)


_WINDOWS = rf"""
lines AS (
  SELECT doc_id, md5(COALESCE(doc_id::VARCHAR, '-') || chr(0) || COALESCE(text, '')) AS k, pos, line,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, text, unnest(range(len(l))) AS pos, regexp_replace(unnest(l), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
  WHERE line <> ''),
sums AS (
  SELECT *, SUM(words) OVER (PARTITION BY k ORDER BY pos) AS upto, SUM(words) OVER (PARTITION BY k) AS total FROM lines),
windows AS (
  SELECT doc_id, k, 'ahead' AS way, upto - words AS begin, total,
    MIN(pos) OVER a AS first, MAX(pos) OVER a AS last, string_agg(line, chr(10)) OVER a AS content
  FROM sums WINDOW a AS (PARTITION BY k ORDER BY upto - words RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, k, 'back', total - upto, total,
    MIN(pos) OVER b, MAX(pos) OVER b, string_agg(line, chr(10)) OVER b
  FROM sums WINDOW b AS (PARTITION BY k ORDER BY upto RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT doc_id, k, 'line', 0, {MIN_WORDS}, pos, pos, line FROM sums WHERE words >= {SHORT_WORDS} AND words < {MIN_WORDS}),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY way, content ORDER BY doc_id NULLS FIRST, k, first) AS nth
  FROM windows WHERE total - begin >= {MIN_WORDS}),
gone AS (SELECT DISTINCT k, unnest(range(first, last + 1)) AS pos FROM ranked WHERE nth > 1)"""

ORACLE = rf"""
WITH {_WINDOWS},
pieces AS (
  SELECT doc_id, text, k, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, text, md5(COALESCE(doc_id::VARCHAR, '-') || chr(0) || COALESCE(text, '')) AS k, string_split(text, chr(10)) AS l FROM documents)),
kept AS (
  SELECT p.k, string_agg(p.line, chr(10) ORDER BY p.pos) AS text
  FROM pieces p ANTI JOIN gone g ON p.k = g.k AND p.pos = g.pos GROUP BY p.k)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE COALESCE(kept.text, '') END AS text
FROM documents d LEFT JOIN kept ON kept.k = md5(COALESCE(d.doc_id::VARCHAR, '-') || chr(0) || COALESCE(d.text, ''))
"""
