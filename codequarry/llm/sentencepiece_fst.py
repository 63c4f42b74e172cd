"""SentencePiece encoding and decoding by shortest paths in a weighted finite-state transducer.

Compiled from a model file:

* the normaliser: a space becomes the mark, and one mark is put before a text that isn't empty;
* the piece transducer: a prefix tree of all pieces, which reads characters and writes a piece's number;
* byte fallback: a character that no piece covers is written as its UTF-8 bytes' numbers.

Composing these with an input gives a lattice over its positions, and the encoding is its shortest path in the
tropical semiring (weights add along a path, the least sum wins). For unigram models a piece weighs minus its
log-probability. Byte-pair models have no additive score that gives their encoding; for these the lattice is also
composed with an acceptor of pairs: two pieces may follow each other (weight 0, else infinite) if merging their
characters by rank gives just these two. The encoding is the only path on which all neighbours fit, as a merge
across a border depends on nothing but the two pieces at it. The acceptor is built for the pairs that occur.

No piece has a mark after another character, so no path crosses the start of a run of marks: a text is cut
there, and each distinct stretch is encoded once for as long as it stays in a bounded memory.
"""

from __future__ import annotations

import codecs
import hashlib
import pickle
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codequarry.llm import wordscan

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 400_000
LONG = 48

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def load(path: str = MODEL) -> dict:
    """The tables of a model file, read on the driver. Models with character maps or user-defined pieces are refused."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    model = format_.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    kind = model.trainer_spec.model_type
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or kind not in (UNIGRAM, BPE):
        raise ValueError("only models with an identity normaliser, of the kinds unigram and BPE, are supported")
    if any(p.type == USER_DEFINED for p in model.pieces):
        raise ValueError("user-defined pieces are not supported")
    tables = {
        "kind": kind,
        "prefix": rules.add_dummy_prefix,
        "pieces": [(p.piece, p.score, p.type) for p in model.pieces],
        "unknown": next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN),
        "never": frozenset(),
    }
    if kind == BPE:  # pieces that merging never makes
        first = Codec(tables)
        tables["never"] = frozenset(i for p, i in first.number.items() if first.merged(p) != [p])
    return tables


class Codec:
    """The compiled transducer with its memory; one per task."""

    def __init__(self, tables: dict):
        self.bpe, self.prefix, self.unknown = tables["kind"] == BPE, tables["prefix"], tables["unknown"]
        pieces = tables["pieces"]
        self.number = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = [s for _, s, _ in pieces]
        self.rank = {p: -self.score[i] for p, i in self.number.items()}
        self.piece = [p for p, _, _ in pieces]
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        # every beginning of a piece, with the arcs along it, longest first: what may be a piece there, and its first character in any case
        self.tree: dict[str, tuple[str, ...]] = {}
        for part in sorted({p[:n] for p in self.number for n in range(1, len(p) + 1)}, key=len):
            shorter = self.tree.get(part[:-1], ())
            may_end = len(part) == 1 or (part in self.number and self.number[part] not in tables["never"])
            self.tree[part] = (part, *shorter) if may_end else shorter
        self.least = min(self.score[i] for i in self.number.values()) - 10.0 if self.number else 0.0
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        if any(MARK in p.lstrip(MARK) for p in self.number):
            self.cut = re.compile("(?s).+")
        self.pairs: dict[str, dict[str, bool]] = {}
        self.known_pairs = 0
        self.written = [self._bytes(p, kind) for p, _, kind in pieces]
        codecs.register_error("each byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.begin = array("i"), array("q", [0])

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if text and self.prefix else text

    def merged(self, text: str) -> list[str]:
        """Merging of neighbours by rank, the leftmost of equals first, as long as any two make a piece."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = at = None
            for i, joint in enumerate(map(str.__add__, parts, parts[1:])):
                r = rank.get(joint)
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        found = self.pairs.get(a, {}).get(b)
        if found is None:
            if self.known_pairs >= REMEMBERED:
                self.pairs.clear()
                self.known_pairs = 0
            found = self.pairs.setdefault(a, {})[b] = self.merged(a + b) == [a, b]
            self.known_pairs += 1
        return found

    def arcs(self, text: str, at: int) -> tuple[str, ...]:
        """What the piece transducer can read at a position, longest first: pieces, or a character that only bytes cover.

        Beginnings of a beginning are beginnings, so the longest one is sought up or down from a usual length.
        """
        tree, end = self.tree, at + 4
        found = tree.get(text[at:end]) if end <= len(text) else None
        if found is None:
            end = min(end - 1, len(text))
            while end > at:
                found = tree.get(text[at:end])
                if found is not None:
                    return found
                end -= 1
            return (text[at],)
        size = len(text)
        while end < size:
            end += 1
            more = tree.get(text[at:end])
            if more is None:
                break
            found = more
        return found

    def shortest(self, text: str) -> list[str]:
        """The shortest path through the lattice of ``text``; its states are a position with the piece that leads there."""
        return self._all_fit(text) if self.bpe else self._least(text)

    def _all_fit(self, text: str) -> list[str]:
        """With weights 0 and infinity any path of finite weight is shortest: depth first, no dead state entered twice."""
        size, fits, known, none = len(text), self.fits, self.pairs, {}
        path: list[str] = []
        at, last, dead = 0, None, set()
        arcs = iter(self.arcs(text, 0))
        left = []
        while at < size:
            after = known.get(last, none)
            for piece in arcs:
                if last is not None:
                    fit = after.get(piece)
                    if not (fits(last, piece) if fit is None else fit):
                        continue
                if dead and (at + len(piece), piece) in dead:
                    continue
                left.append((arcs, at, last))
                path.append(piece)
                at, last = at + len(piece), piece
                arcs = iter(self.arcs(text, at)) if at < size else iter(())
                break
            else:
                dead.add((at, last))
                arcs, at, last = left.pop()
                path.pop()
        return path

    def _least(self, text: str) -> list[str]:
        best: list = [(0.0, 0)] + [None] * len(text)
        for at in range(len(text)):
            if best[at] is None:
                continue
            for piece in self.arcs(text, at):
                number, end = self.number.get(piece), at + len(piece)
                cost = best[at][0] - (self.score[number] if number is not None else self.least)
                if best[end] is None or cost < best[end][0]:
                    best[end] = (cost, at)
        path, at = [], len(text)
        while at > 0:
            path.append(text[best[at][1] : at])
            at = best[at][1]
        return path[::-1]

    def numbers(self, path: list[str]) -> list[int]:
        out = list(map(self.number.get, path))
        if None not in out:
            return out
        out.clear()
        for piece in path:
            number = self.number.get(piece)
            if number is not None:
                out.append(number)
            elif self.byte:
                out.extend(self.byte[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:  # a run of unknown characters is one
                out.append(self.unknown)
        return out

    def learn(self, stretch: str) -> int:
        self.flat.extend(self.numbers(self.shortest(stretch)))
        self.begin.append(len(self.flat))
        place = self.place[stretch] = len(self.begin) - 2
        return place

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts in a row, and where each text begins (and the last ends)."""
        if len(self.place) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self._forget()
        place, cut, places, counts, long = self.place, self.cut, array("q"), [], []
        for text in texts:
            stretches = cut.findall(self.normalise(text))
            counts.append(len(stretches))
            for s in stretches:
                i = place.get(s)
                if i is None:
                    i = self.learn(s)
                    if len(s) > LONG:
                        long.append(s)
                places.append(i)
        at = np.frombuffer(places, np.int64) if places else np.empty(0, np.int64)
        begin = np.frombuffer(self.begin, np.int64).copy()
        flat = np.frombuffer(self.flat, np.int32).copy() if self.flat else np.empty(0, np.int32)
        sizes = begin[at + 1] - begin[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = flat[np.repeat(begin[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        if sum(map(len, long)) > 1 << 20:  # stretches without spaces aren't worth their memory
            self._forget()
        return out, ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def decode(self, numbers: list[int]) -> str:
        """The text that the numbers stand for; each byte that is in no UTF-8 character gives the replacement character."""
        raw = b"".join(map(self.written.__getitem__, numbers))
        first = next((self.piece[i] for i in numbers if self.written[i]), "")
        if self.prefix and first.startswith(MARK):
            raw = raw[1:]
        return raw.decode(errors="each byte")


def codec(tables: dict) -> Codec:
    """The compiled model of this worker process, which Spark uses for many tasks; so its memory outlives a task."""
    memory = sys.modules.setdefault("codequarry_worker_memory", types.ModuleType("codequarry_worker_memory"))
    name = "codec_" + hashlib.md5(pickle.dumps(tables["pieces"])).hexdigest()
    if not hasattr(memory, name):
        setattr(memory, name, Codec(tables))
    return getattr(memory, name)


def encode(docs: DataFrame, model: str = MODEL, check: bool = False) -> DataFrame:
    """All columns of ``docs`` but ``text``, plus ``token_ids`` (and with ``check``, ``round_trip``).

    A null text gives null, an empty one an empty list; ``token_ids`` and ``round_trip`` replace columns of
    that name. ``round_trip`` says whether decoding gives back the text, apart from marks that were in the text
    itself, which read as spaces. Texts of any length are encoded whole.
    """
    wordscan.small_batches(docs.sparkSession)
    tables = docs.sparkSession.sparkContext.broadcast(load(model))
    others = [c for c in docs.columns if c not in ("text", "token_ids", "round_trip")]
    docs = docs.select(*others, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tables.value)
        for batch in batches:
            column = batch.column(len(others))
            for lo, hi in wordscan.slices(wordscan.as_bytes(column)):
                texts = column.slice(lo, hi - lo).to_pylist()
                ids, begin = own.encode([t or "" for t in texts])
                missing = np.array([t is None for t in texts] + [False])
                lists = pa.LargeListArray.from_arrays(pa.array(begin, pa.int64(), mask=missing), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))
                extra = [lists]
                if check:
                    same = [t is None or own.decode(ids[a:b].tolist()) == t.replace(MARK, " ") for t, a, b in zip(texts, begin[:-1], begin[1:], strict=True)]
                    extra.append(pa.array(same))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], *extra], [*others, "token_ids", *["round_trip"] * check])
        wordscan.give_back()

    schema = docs.drop("text").schema.add("token_ids", T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(run, schema.add("round_trip", "boolean") if check else schema)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of ``rows`` but ``token_ids``, plus ``text``. A null list gives null; numbers outside the vocabulary fail."""
    tables = rows.sparkSession.sparkContext.broadcast(load(model))
    others = [c for c in rows.columns if c not in ("text", "token_ids")]
    rows = rows.select(*others, "token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tables.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = pa.array([None if x is None else own.decode(x) for x in part.column(len(others)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], [*others, "text"])

    return rows.mapInArrow(run, rows.drop("token_ids").schema.add("text", "string"))


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True)
