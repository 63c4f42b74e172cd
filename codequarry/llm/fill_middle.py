"""Fill-in-the-middle: texts are cut in three, and the parts are put in an order that ends with the middle.

Cuts are places among a text's units (tokens, say). They are found on a wavelet matrix over the classes of the text's
bytes: a letter that begins a run, a letter inside a run, another character, a byte inside a character. A
rank query gives the number of bytes of one class before a place. Units begin at bytes of certain classes, so the
number of units begun before a place is a sum of ranks, and so is the number of code points. Both cuts are found by
bisection on these counts, for all texts of a slice at once: no text is split into units, and a text of any length
takes memory in proportion to it and as many rank queries as its length has binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codequarry.llm import wordscan

SEED = "1"
PLAIN_FROM, SPM_BELOW = 90, 20
MARKS = ("<P>", "<S>", "<M>")
SLICE = 1 << 20

INSIDE, RUN, FIRST, OTHER = range(4)  # a byte within a character; a letter in a run; a letter that begins one; other characters
#: Classes at which a unit begins.
UNITS = {"token": (FIRST, OTHER), "char": (RUN, FIRST, OTHER)}
_LEVELS = 2
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def classes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that lie one after the other; no run goes over a text's border."""
    letter = _ASCII_LETTER[data]
    out = np.full(len(data), OTHER, np.uint8)
    out[(data & 0xC0) == 0x80] = INSIDE
    out[letter] = FIRST
    follows = letter.copy()
    follows[1:] &= letter[:-1]
    follows[:1] = False
    borders = bounds[:-1]
    follows[borders[borders < len(data)]] = False
    out[follows] = RUN
    return out


class WaveletMatrix:
    """A sequence of small numbers with rank queries: per level one bit of each number, zeros moved ahead of ones."""

    def __init__(self, values: np.ndarray, levels: int = _LEVELS):
        self.levels, self.before, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, np.int32 if len(values) < 1 << 31 else np.int64)
            np.cumsum(bit, out=ones[1:])
            self.before.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before each of the places ``at``."""
        low, high = np.zeros_like(at), at
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.before[i]
            if value >> level & 1:
                low, high = self.zeros[i] + ones[low], self.zeros[i] + ones[high]
            else:
                low, high = low - ones[low], high - ones[high]
        return high - low

    def count(self, wanted: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(v, at) for v in wanted)

    def cut(self, wanted: tuple[int, ...], first: np.ndarray, last: np.ndarray, units: np.ndarray) -> np.ndarray:
        """For stretches [first, last) the place behind which ``units`` units have gone: the last place with no more begun before it.

        Between a unit's end and the next one's beginning nothing lies, so that is where the next unit begins.
        """
        base = self.count(wanted, first)
        low, high = first.copy(), last.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.count(wanted, middle) - base <= units
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _cuts(unit: str, schema: pa.Schema):
    """Batches of (key, text, u1, u2, ...) to (key, text's units, cut places in bytes, code points of prefix and middle)."""
    wanted = UNITS[unit]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = wordscan.as_bytes(pa.compute.fill_null(batch.column("text"), ""))
            bounds, data = wordscan.offsets(texts), texts.buffers()[2]
            data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            for lo, hi in wordscan.slices(texts, SLICE):
                own = bounds[lo : hi + 1] - bounds[lo]
                part = data[bounds[lo] : bounds[hi]]
                matrix = WaveletMatrix(classes(part, own))
                first, last = own[:-1], own[1:]
                n = matrix.count(wanted, last) - matrix.count(wanted, first)
                draws = [batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("h1", "h2")]
                units = np.sort([h % (n + 1) for h in draws], axis=0)
                places = [first, *(matrix.cut(wanted, first, last, u) for u in units), last]
                chars = [matrix.count(UNITS["char"], b) - matrix.count(UNITS["char"], a) for a, b in zip(places, places[1:], strict=False)]
                yield from _parts(batch.slice(lo, hi - lo), part, n, places, chars, schema)

    return found


def _parts(rows: pa.RecordBatch, data: np.ndarray, n: np.ndarray, places: list[np.ndarray], chars: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    raw = data.tobytes()
    marks = [m.encode() for m in MARKS]
    out, forms = [], []
    for i, (form, a, b, c, d) in enumerate(zip(rows.column("form").to_pylist(), *places, strict=True)):
        text = raw[a:d]
        if not text or any(m in text for m in marks):
            form = "plain"
        forms.append(form)
        before, middle, after = raw[a:b], raw[b:c], raw[c:d]
        p, s, m = marks
        out.append(text if form == "plain" else p + before + s + after + m + middle if form == "psm" else s + after + p + before + m + middle)
    cut = pa.array([f == "plain" for f in forms])
    columns = {
        **{name: rows.column(name) for name in rows.schema.names if name not in ("text", "h1", "h2", "form")},
        "n": pa.array(n.astype(np.int64)),
        "form": pa.array(forms, pa.string()),
        "prefix_chars": pa.compute.if_else(cut, None, pa.array(chars[0].astype(np.int64))),
        "middle_chars": pa.compute.if_else(cut, None, pa.array(chars[1].astype(np.int64))),
        "output": pa.array(out, pa.binary()).cast(pa.string()),
    }
    yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)


def transform(docs: DataFrame, unit: str = "token", seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n, form, prefix_chars, middle_chars, output``, one row per input row.

    ``unit``: ``token`` (a run of Latin letters or one other character) or ``char``. Four numbers come from the sha256 of
    ``seed:doc_id``: two for the cuts, modulo units + 1, one for keeping the text plain (remainder by 100 of
    ``plain_from`` or more) and one for suffix-first (``spm``, below ``spm_below``) against prefix-first (``psm``) form.

    Null and empty texts and texts that contain a mark (``MARKS``) come out plain, null as empty; plain rows have
    no counts of characters. A null id draws like an empty one. Repeated rows and rows of one id are each transformed; rows
    of one id draw the same numbers. Texts are not changed otherwise, whatever their length. Other columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)

    def draw(i: int) -> Column:
        return F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("bigint")

    form = F.when(draw(2) % 100 >= plain_from, "plain").when(draw(3) % 100 < spm_below, "spm").otherwise("psm")
    rows = docs.select("doc_id", "text", digest.alias("_digest")).select("doc_id", "text", draw(0).alias("h1"), draw(1).alias("h2"), form.alias("form"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    schema = docs.sparkSession.createDataFrame([], result).schema
    return rows.mapInArrow(_cuts(unit, to_arrow_schema(schema)), schema)


def restore(df: DataFrame, name: str = "text") -> DataFrame:
    """Add the text that ``form`` and ``output`` came from, as column ``name``.

    Texts with marks are plain, so the three marks of another output are the only ones in it: parts can't make
    up a mark with each other or with a mark, as ``<`` stands only at a mark's beginning.
    """
    part = F.split("output", "<[PSM]>", -1)
    text = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(part[1], part[3], part[2]))
    return df.withColumn(name, text.otherwise(F.concat(part[2], part[3], part[1])))


def query(spark, folder: str) -> DataFrame:
    made = restore(transform(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")), "restored")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in [0, 1, 2, 3]] AS d FROM units),
cut AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS p, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= {PLAIN_FROM} THEN 'plain' WHEN d[4] % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(list_slice(u, 1, p), '') AS a, array_to_string(list_slice(u, p + 1, q), '') AS b, array_to_string(list_slice(u, q + 1, n), '') AS c FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
