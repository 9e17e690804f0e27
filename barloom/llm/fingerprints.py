"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last 7 bytes, taken at every byte, ends a chunk where its low `level` bits are all ones. Chunks shorter than
a quarter of the block size, 2**level bytes, go on, and those of four block sizes end, so that a signature has 16 to 256
chunks for text of any kind. Each chunk's hash gives two characters of the signature, repeats too. The level follows from the length: about 32 to 64 chunks, from LEVEL on. A fingerprint is
level:signature:signature at the next level. Two fingerprints are compared at the block size that both have, where levels
are equal or differ by one: twice the longest common subsequence of chunks over the chunks in all, that is one minus their
edit distance (insertions and deletions) by its largest value. Other levels give 0.

Cases: null and empty texts have the fingerprint of no chunks; two of these are alike with 1, one of them and another
text with 0. Equal texts have equal fingerprints. Repeated rows and rows with null ids, which come last, are rows of their own; ties of
ids go by a hash of the text; very long texts are worked on by themselves; other columns play no part; an empty table gives an
empty result, and a single row is its own next one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

WIDTH, LEVEL, CHUNKS = 7, 2, 64
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = [a + b for a in DIGITS for b in DIGITS]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_MIX = [np.uint32(pow(0x01000193, WIDTH - k, 1 << 32)) for k in range(WIDTH)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to the longest text so far."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, x in enumerate((_BASE, _BACK)):
            row = np.full(size, x, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers


def _signature(prefix: np.ndarray, roll: np.ndarray, level: int, back: np.ndarray) -> str:
    """Two characters for each chunk. prefix[i]: sum of byte * base**position before i, of which chunks' sums
    are differences, moved back to position 0."""
    n, block = roll.size, 1 << level
    mask = np.uint32(block - 1)
    ends = (np.flatnonzero((roll & mask) == mask) + 1).tolist()
    cuts, k = [0], 0
    while cuts[-1] < n:
        k = bisect_left(ends, cuts[-1] + max(1, block // 4), k)
        cuts.append(min(ends[k] if k < len(ends) else n, cuts[-1] + 4 * block, n))
    h = (prefix[cuts[1:]] - prefix[cuts[:-1]]) * back[cuts[:-1]]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return "".join([_PAIRS[i] for i in (h >> np.uint64(52)).tolist()])


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = data.size
    if not n:
        return f"{LEVEL}::"
    power, back = _power(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[:n], out=prefix[1:])
    wide = data.astype(np.uint32)
    roll = np.zeros(n, np.uint32)
    for k in range(min(WIDTH, n)):
        roll[k:] += wide[: n - k] * _MIX[k]
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    level = max(LEVEL, ((n - 1) // CHUNKS).bit_length())
    return f"{level}:{_signature(prefix, roll, level, back)}:{_signature(prefix, roll, level + 1, back)}"


def _common(a: str, b: str) -> int:
    """Longest common subsequence of two signatures' chunks, a row of the table being one integer's bits."""
    at: dict[str, int] = {}
    n = len(a) // 2
    for i in range(n):
        c = a[2 * i : 2 * i + 2]
        at[c] = at.get(c, 0) | 1 << i
    row = full = (1 << n) - 1
    for j in range(0, len(b), 2):
        if m := row & at.get(b[j : j + 2], 0):
            row = ((row + m) | (row - m)) & full
    return n - row.bit_count()


def likeness(x: str | None, y: str | None) -> float:
    if x is None or y is None:
        return 0.0
    if x == y:
        return 1.0
    (i, a1, a2), (j, b1, b2) = x.split(":"), y.split(":")
    gap = int(i) - int(j)
    a, b = {0: (a1, b1), 1: (a1, b2), -1: (a2, b1)}.get(gap, ("", ""))
    return 4.0 * _common(a, b) / (len(a) + len(b)) if a and b else 0.0


def edited(text: str, after: str) -> str:
    """A text whose last third is replaced by as many of the next one's characters."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third] if third else text


#: done: a row's results; first, last: a partition's first text and its last row, whose next one lies in another partition.
_ROW = "kind string, part int, doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _result(part: int, name: str | None, text: str, mark: str, after: str, after_mark: str) -> tuple:
    other = edited(text, after)
    other_mark = mark if other == text else fingerprint(other)
    return ("done", part, name, len(text), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(), mark, other_mark, likeness(mark, other_mark), likeness(mark, after_mark), None)


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    held = None
    for b in batches:
        out = []
        for name, text in zip(b["doc_id"].tolist(), b["text"].tolist()):
            mark = fingerprint(text)
            if held is None:
                out.append(("first", part, None, None, None, mark, None, None, None, text))
            else:
                out.append(_result(part, *held, text, mark))
            held = name, text, mark
        yield pd.DataFrame(out, columns=_NAMES)
    if held is not None:
        name, text, mark = held
        yield pd.DataFrame([("last", part, name, None, None, mark, None, None, None, text)], columns=_NAMES)


def _over_borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([_result(r.part, r.doc_id, r.text, r.fingerprint, r.after, r.after_mark) for r in b.itertuples(index=False)], columns=_NAMES)


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last third is replaced by the next text's start,
    with their likeness and that of the next text.

    Rows are range-partitioned by descending id (null ids last) and a hash of the text, which splits ids that many rows have, and
    each is compared with the next one in its partition. The last row of a partition meets the first one of the next by a join of
    one row for each partition; the driver holds the partitions' numbers.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    placed = own.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text")
    rows = materialize(placed.select(F.col("id").cast("string").alias("doc_id"), "text").mapInPandas(_in_order, _ROW), "marked")
    parts = sorted(r["part"] for r in rows.filter("kind = 'first'").select("part").collect())  # one for each partition at most
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "p int, then int")
    firsts = rows.filter("kind = 'first'").select(F.col("part").alias("q"), F.col("text").alias("after"), F.col("fingerprint").alias("after_mark"))
    lasts = rows.filter("kind = 'last'").join(F.broadcast(following), F.col("part") == F.col("p")).join(firsts, F.col("then") == F.col("q"))
    every = rows.filter("kind = 'done'").unionByName(lasts.select("part", "doc_id", "text", "fingerprint", "after", "after_mark").mapInPandas(_over_borders, _ROW))
    return every.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
