"""Alignment of two tokenizers' tokens over one text, by sparse incidence matrices.

Tokens of either tokenizer cut the same bytes. Their incidence matrices (tokens x bytes) are kept in compressed rows (CSR), and
the row product A * B' (each row of A gathers the rows of B' that its columns name, Gustavson's way) has an entry for every
pair of tokens that overlap: the number of bytes that they share. Byte offsets at which tokens of both sides end cut the
text into groups; the product of the incidence matrices tokens x groups has an entry for each pair within one group.

`links` gives the links of every document as rows; `measure` gives counts, a digest of the groups, and how often the linked
ids are linked in the whole corpus. For the latter, documents are taken in blocks of BLOCK bytes or so: a block keeps each
pair of ids once, asks for its corpus-wide count by a join on the pair, and adds up over its documents what it gets. So a
pair that occurs in every document is one row for each block, and what is shuffled is about the distinct pairs
of blocks. Only the highest count of each B id is broadcast, at most a row for each id of that vocabulary.

Cases: null and empty texts have no tokens, nor have texts whose tokens' bytes aren't the text (a character that stands for a
space in B's vocabulary, say); repeated rows are documents of their own; null ids are kept; an empty table gives an
empty result; other columns play no part. A text is encoded whole in one task; long ones in A by pieces that are joined,
in B by runs between spaces, over which no merge reaches. The matrices are made for about STRETCH bytes at a time.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import materialize

#: Bytes of text in a block, and bytes for which matrices are made at once.
BLOCK, STRETCH = 8 << 20, 1 << 18
#: Characters from which a text is encoded in pieces by A where the library would have to take it whole.
LONG = 1 << 18
#: Runs between spaces whose ids a worker remembers.
REMEMBERED = 300_000

KINDS = ("overlap", "end", "group")


class Csr(NamedTuple):
    """A sparse matrix of whole numbers in compressed rows."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of_spans(cls, ends: np.ndarray, first: int, width: int) -> Csr:
        """Row i has a one in every column from the end of row i - 1 (the first: `first`) up to its own."""
        starts = np.append(first, ends) - first
        return cls(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), width)

    @classmethod
    def of_places(cls, columns: np.ndarray, width: int) -> Csr:
        """One entry a row."""
        return cls(np.arange(columns.size + 1), columns, np.ones(columns.size, np.int64), width)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(self.starts.size - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(self.columns, minlength=self.width)))
        return Csr(starts, rows[order], self.values[order], self.starts.size - 1)

    def times(self, other: Csr) -> Csr:
        """The product, row by row: an entry of a row gathers the row of `other` that its column names."""
        sizes = np.diff(other.starts)[self.columns]
        total = int(sizes.sum())
        gathered = np.arange(total) + np.repeat(other.starts[self.columns] - np.cumsum(sizes) + sizes, sizes)
        rows = np.repeat(np.repeat(np.arange(self.starts.size - 1), np.diff(self.starts)), sizes)
        key = rows * other.width + other.columns[gathered]
        values = np.repeat(self.values, sizes) * other.values[gathered]
        if total and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if total else np.zeros(0, np.int64)
        key, values = key[new], np.add.reduceat(values, new) if total else values
        at, columns = np.divmod(key, other.width) if total else (key, key)
        return Csr(np.append(0, np.cumsum(np.bincount(at, minlength=self.starts.size - 1))), columns, values, other.width)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(self.starts.size - 1), np.diff(self.starts)), self.columns, self.values


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Offsets at which tokens of both sides end."""
    return np.intersect1d(a, b, assume_unique=True)


def stretches(a: np.ndarray, b: np.ndarray, groups: np.ndarray, most: int = STRETCH) -> Iterator[tuple[slice, slice, int, int]]:
    """(tokens of A, tokens of B, first byte, end) of stretches of whole groups, of about `most` bytes or one group."""
    lo = 0
    while groups.size and lo < groups[-1]:
        k = max(int(np.searchsorted(groups, lo + most, "right")) - 1, int(np.searchsorted(groups, lo, "right")))
        hi = int(groups[k])
        yield *(slice(*(int(np.searchsorted(x, v, "right")) for v in (lo, hi))) for x in (a, b)), lo, hi
        lo = hi


def linked(a: np.ndarray, b: np.ndarray, groups: np.ndarray, kind: str = "overlap") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in A, places in B, shared bytes or 1) of the links of two token sequences given by their ends, a stretch at a
    time. overlap: tokens that share bytes; end: those of them that end together; group: tokens of one group."""
    for x, y, lo, hi in stretches(a, b, groups):
        if kind == "group":
            width = groups.size
            parts = [Csr.of_places(np.searchsorted(groups, e), width) for e in (a[x], b[y])]
        else:
            parts = [Csr.of_spans(e, lo, hi - lo) for e in (a[x], b[y])]
        i, j, n = parts[0].times(parts[1].transposed()).entries()
        if kind == "end":
            keep = a[x][i] == b[y][j]
            i, j, n = i[keep], j[keep], n[keep]
        yield i + x.start, j + y.start, n


class Bytewise(bpe.Tokenizer):
    """A: byte-level BPE, special tokens' strings being plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values() if not t.special]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.reach = max(map(len, self.specials), default=0)
        self.tokens = self._token_bytes()

    def ids(self, text: str) -> bytes:
        if len(text) <= LONG or not bpe.ODD.search(text):
            return self.encode(text)
        pieces = [text[i : i + LONG] for i in range(0, len(text), LONG)]
        return self.tree(pieces, [self.piece(p) for p in pieces]).tobytes()


class Pieces(dict):
    """B: sentencepiece BPE, which marks spaces and adds one in front; a table of run -> ids, for runs that start with spaces.

    Runs are encoded apart: the constructor checks that no piece has a mark after another character, so that no merge
    reaches over a run's start.
    """

    runs = re.compile(" +[^ ]*")

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.apart = "▁" in pieces and not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = np.array([self.library.piece_to_id("▁")], "<u4").tobytes()
        self.tokens = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.apart:
            return [np.array(x, "<u4").tobytes() for x in self.library.encode(texts, num_threads=1)]
        found = [self.runs.findall(" " + t) for t in texts]
        if len(self) > REMEMBERED:
            self.clear()
        self[" "] = self.space  # at a text's end: the library adds no space in front of nothing
        new = list({r for runs in found for r in runs if r not in self})
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            self.update(zip(part, [np.array(x, "<u4").tobytes() for x in self.library.encode([r[1:] for r in part], num_threads=1)]))
        return [b"".join([self[r] for r in runs]) for runs in found]


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> tuple[Bytewise, Pieces]:
    """One pair for each worker process."""
    return Bytewise(path_a), Pieces(path_b)


class Side(NamedTuple):
    """Tokens of several texts, one after the other: ids, end offsets in all texts' bytes, and the first token of each text."""

    ids: np.ndarray
    ends: np.ndarray
    starts: np.ndarray


def encoded(texts: list[str | None], a: Bytewise, b: Pieces) -> tuple[Side, Side, np.ndarray]:
    """Both sides, and the offset at which each text's bytes end. Texts without tokens have none on either side."""
    given = [t or "" for t in texts]
    both = [[a.ids(" " + t) if t else b"" for t in given], b.many(given)]
    size = np.zeros(len(given), np.int64)
    for k, t in enumerate(given):
        want = b" " + t.encode("utf-8", "surrogatepass") if t else b""
        if t and all(b"".join([x.tokens[i] for i in array("I", ids[k])]) == want for x, ids in ((a, both[0]), (b, both[1]))):
            size[k] = len(want)
        else:
            both[0][k] = both[1][k] = b""
    ends = np.cumsum(size)
    sides = []
    for x, ids in zip((a, b), both):
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        sides.append(Side(flat, np.cumsum(lengths(x)[flat]), np.append(0, np.cumsum([len(i) // 4 for i in ids]))))
    return sides[0], sides[1], ends


def lengths(x: Bytewise | Pieces) -> np.ndarray:
    if not hasattr(x, "sizes"):
        x.sizes = np.array([len(t) for t in x.tokens], np.int64)
    return x.sizes


def taken(texts: Iterable[str | None], most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters; a longer text alone."""
    lo = size = hi = 0
    for hi, t in enumerate(texts):
        n = len(t or "")
        if hi > lo and size + n > most:
            yield lo, hi
            lo, size = hi, 0
        size += n
    if size or hi >= lo:
        yield lo, hi + 1


_LINK = pa.schema([("doc_id", pa.string()), ("a_place", pa.int32()), ("b_place", pa.int32()), ("a_id", pa.int32()), ("b_id", pa.int32()), ("shared", pa.int32())])


def links(docs: DataFrame, path_a: str, path_b: str, kind: str = "overlap", *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a_place, b_place, a_id, b_id, shared) of every link: places of the tokens in their document, from 0."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    of = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in taken(texts) if texts else ():
                a, b, _ = encoded(texts[lo:hi], *t)
                for i, j, n in linked(a.ends, b.ends, common_ends(a.ends, b.ends), kind):
                    k = np.searchsorted(a.starts, i, "right") - 1
                    names = pa.array([ids[lo + x] for x in k.tolist()], pa.string())
                    rest = [i - a.starts[k], j - b.starts[k], a.ids[i], b.ids[j], n]
                    yield pa.RecordBatch.from_arrays([names, *(pa.array(x.astype(np.int32)) for x in rest)], schema=_LINK)

    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text"))
    out = own.mapInArrow(run, "doc_id string, a_place int, b_place int, a_id int, b_id int, shared int")
    return out.withColumn("doc_id", F.col("doc_id").cast(of))


class Text:
    """Writes groups as text: ids of A, then of B, each followed by its separator."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.first_b = 2 * n_a
        self.table = [f"{i}{s}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for i in range(n) for s in marks]

    def codes(self, a: Side, b: Side, groups: np.ndarray) -> np.ndarray:
        """Entries of the table in the order of the text."""
        in_a, in_b = (np.searchsorted(groups, x.ends) for x in (a, b))
        upto_a, upto_b = (np.append(0, np.searchsorted(x.ends, groups, "right")) for x in (a, b))
        out = np.empty(a.ids.size + b.ids.size, np.int64)
        out[np.arange(a.ids.size) + upto_b[in_a]] = 2 * a.ids + (groups[in_a] == a.ends)
        out[np.arange(b.ids.size) + upto_a[in_b + 1]] = self.first_b + 2 * b.ids + (groups[in_b] == b.ends)
        return out

    def digest(self, codes: list[int]) -> str:
        return hashlib.sha256("".join([self.table[c] for c in codes])[:-1].encode()).hexdigest() if codes else ""


_DOC = "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, pairs binary, counts binary"
_DOC_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.string()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), *((c, pa.binary()) for c in ("at", "times", "pairs", "counts"))])


class _Block:
    """Documents of a block with their links, until it is full."""

    def __init__(self) -> None:
        self.rows, self.keys, self.of, self.size = [], [], [], 0

    def add(self, ids: list, texts: list, t: tuple[Bytewise, Pieces], writer: Text) -> None:
        a, b, ends = encoded(texts, *t)
        groups = common_ends(a.ends, b.ends)
        group_at = np.append(0, np.searchsorted(groups, ends, "right"))
        n_links = np.zeros(len(ids), np.int64)
        for i, j, _ in linked(a.ends, b.ends, groups, "end"):
            k = np.searchsorted(a.starts, i, "right") - 1
            n_links += np.bincount(k, minlength=len(ids))
            self.keys.append(a.ids[i] << 32 | b.ids[j])
            self.of.append(k + len(self.rows))
        codes, cuts = writer.codes(a, b, groups), a.starts + b.starts
        for k, i in enumerate(ids):
            n = cuts[k + 1] - cuts[k]
            digest = writer.digest(codes[cuts[k] : cuts[k + 1]].tolist()) if n else ""
            self.rows.append((i, int(a.starts[k + 1] - a.starts[k]), int(b.starts[k + 1] - b.starts[k]), int(group_at[k + 1] - group_at[k]), int(n_links[k]), digest))
        self.size += int(ends[-1]) if ends.size else 0

    def written(self, block: int) -> pa.RecordBatch:
        """A row for each document with places in the block's pairs, and one row with these pairs."""
        keys, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.keys, self.of))
        pairs, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
        both, times = np.unique(of << 32 | at, return_counts=True)
        cuts = np.searchsorted(both, np.arange(len(self.rows) + 1) << 32)
        at = (both & 0xFFFFFFFF).astype("<u4")
        times = times.astype("<u4")
        cols = [list(x) for x in zip(*self.rows, (None,) * 6)]
        n = len(self.rows)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        more = [
            [at[x:y].tobytes() for x, y in spans] + [None], [times[x:y].tobytes() for x, y in spans] + [None],
            [None] * n + [pairs.astype("<i8").tobytes()], [None] * n + [counts.astype("<i8").tobytes()],
        ]
        data = [[block] * (n + 1), *cols, *more]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, _DOC_ARROW)], schema=_DOC_ARROW)


def measure(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row; links end together."""
    of = docs.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = tokenizers(path_a, path_b)
        writer = Text(len(t[0].tokens), len(t[1].tokens))
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for lo, hi in taken(texts):
                    block.add(ids[lo:hi], texts[lo:hi], t, writer)
                    if block.size >= BLOCK:
                        yield block.written(number)
                        number, block = number + 1, _Block()
        if block.rows:
            yield block.written(number)
        t[0].forget()
        t[1].clear()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, counts in zip(*(c.to_pylist() for c in batch.columns)):
                p, n = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(p.size, block)), pa.array(p), pa.array(n)], names=["block", "pair", "n"])

    def summed(key: tuple, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("pair")
        count, best = answers["count"].to_numpy(), answers["best"].to_numpy()
        rows = [(np.frombuffer(a, "<u4"), np.frombuffer(n, "<u4").astype(np.int64)) for a, n in zip(own["at"], own["times"])]
        sums = [(int((best[a] * n).sum()), int((count[a] * n).sum())) for a, n in rows]
        return own.drop(columns=["block", "at", "times"]).assign(n_best=[x for x, _ in sums], count_sum=[x for _, x in sums])

    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text"))
    table = materialize(own.mapInArrow(blocks, _DOC), "links", compression="zstd")
    asks = table.filter("pairs is not null").select("block", "pairs", "counts").mapInArrow(asked, "block long, pair long, n long")
    counts = materialize(asks.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    best = counts.groupBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")).agg(F.max("count").alias("highest"))
    known = counts.join(F.broadcast(best), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("b"))
    known = known.select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    answers = asks.select("block", "pair").join(known, "pair").select("block", "pair", "count", "best")
    rows = table.filter("pairs is null").drop("pairs", "counts")
    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(summed, schema)
    return out.select(F.col("doc_id").cast(of).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
