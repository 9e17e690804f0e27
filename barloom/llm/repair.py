"""Token-ID output compressed by a grammar of id pairs (Re-Pair), with random access.

A shard holds the ids of consecutive documents. Frequent pairs of neighbouring ids are replaced by new ids again and
again; each new id has a rule (its two parts) and an expansion length, so that any range of ids is found by a running sum
of lengths and only what covers it is expanded. Pairs never cross documents.

Each round replaces many pairs at once: a table of slots bounds what pairs can be frequent, these are counted exactly and
ranked by count, and where two occurrences overlap the more frequent pair wins; of a run of one id every other place counts. The
rounds end when no pair occurs LEAST times. A pair's count never grows once both its ids are there, so that a round looks only at places
of pairs that were frequent in the round before, and beside new ids.

Format: one row of a Parquet table for each shard, as any store that Spark writes to takes it: bucket and shard (the
order; a bucket is a range of ids), start_in_bucket, n_docs, n_ids, first_new (the first new id), rules (pairs of u32), lengths (u32 of each new id),
sequence (u16 or u32, see width), doc_at (u32 place of each document in the sequence, and the end), doc_ids (strings,
null where the id is). Documents are in ascending order of id, null ids first, and of a hash of their texts where ids are equal.

Cases: null and empty texts have the end id alone; repeated rows and rows with null ids are written one by one; very long texts
are a shard of their own; vocabularies of any size do; other columns play no part; an empty table makes an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer
from .common import partitions

END = 0
#: Ids of a shard, about; a document is never split.
SHARD_IDS = 1 << 20
#: Occurrences from which on a pair becomes a rule, and slots of the table that bounds them.
LEAST, SLOTS = 8, 1 << 18


@dataclass
class Grammar:
    first_new: int
    rules: np.ndarray  # (n, 2)
    lengths: np.ndarray  # of each new id
    sequence: np.ndarray


def distinct(a: np.ndarray, b: np.ndarray, ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs as a << 32 | b in order, number of the pair at each place, count of each pair). ids: one more than the highest.

    A pair and its place are packed into 64 bits where they fit, as one sort of numbers is far quicker than a sort of places.
    """
    wide, far = np.uint64(max(1, int(ids - 1).bit_length())), np.uint64(max(1, a.size).bit_length())
    if not a.size or 2 * wide + far > 64:
        return np.unique(a.astype(np.uint64) << np.uint64(32) | b, return_inverse=True, return_counts=True)
    packed = ((a.astype(np.uint64) << wide | b) << far) | np.arange(a.size, dtype=np.uint64)
    packed.sort()
    place = (packed & ((np.uint64(1) << far) - np.uint64(1))).astype(np.intp)
    packed >>= far
    new = np.append(True, packed[1:] != packed[:-1])
    first = np.flatnonzero(new)
    which = np.empty(a.size, np.int32)
    which[place] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    pairs = packed[first]
    return pairs >> wide << np.uint64(32) | pairs & ((np.uint64(1) << wide) - np.uint64(1)), which, np.diff(np.append(first, a.size))


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> tuple[Grammar, np.ndarray]:
    """The grammar of ids, and the place of each document in its sequence. ends: end of each document in ids.

    The end id stands last in every document and is never part of a pair, so pairs stay inside documents.
    """
    seq, rules, lengths = ids.astype(np.uint32), [], []
    known = np.ones(vocabulary, np.int64)
    shift = np.uint32(32 - SLOTS.bit_length() + 1)
    live = np.flatnonzero((seq[:-1] != END) & (seq[1:] != END))  # where a frequent pair may stand
    while live.size:
        stays = np.zeros(seq.size, bool)  # what is live in the next round
        same = np.flatnonzero(seq[:-1] == seq[1:])
        if same.size:  # of a run of one id, every other place from its start
            k = np.arange(same.size)
            start = np.maximum.accumulate(np.where(np.append(True, np.diff(same) > 1), k, 0))
            stays[same[(k - start) & 1 == 1]] = True
            live = live[~stays[live]]
        a, b = seq[live], seq[live + 1]
        slot = ((a * np.uint32(2654435761)) ^ (b * np.uint32(2246822519))) * np.uint32(3266489917) >> shift
        often = (np.bincount(slot, minlength=SLOTS) >= LEAST)[slot]
        pairs, which, count = distinct(a[often], b[often], known.size)
        if not (count >= LEAST).any():
            break
        rank = np.empty(pairs.size, np.int32)
        rank[np.argsort(-count, kind="stable")] = np.arange(pairs.size, dtype=np.int32)
        rank[count < LEAST] = pairs.size
        place = np.full(seq.size + 1, pairs.size, np.int32)  # shifted by one: place[i + 1] belongs to the pair at i
        place[live[often] + 1] = rank[which]
        mine = place[1:-1]
        at = np.flatnonzero((mine < place[:-2]) & (mine < place[2:]))
        used = np.bincount(mine[at], minlength=pairs.size + 1) >= LEAST  # by rank; the most frequent pair has all its places, so that every round makes a rule
        at = at[used[mine[at]]]
        made = used[rank]
        new = np.empty(pairs.size + 1, np.uint32)
        new[rank] = np.cumsum(made) - 1 + known.size
        parts = np.stack([pairs[made] >> np.uint64(32), pairs[made] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        rules.append(parts)
        lengths.append(known[parts].sum(1))
        known = np.concatenate([known, lengths[-1]])
        seq[at] = new[mine[at]]
        stays[:-1] |= mine < pairs.size
        stays[at] = stays[np.maximum(at - 1, 0)] = True
        keep = np.ones(seq.size, bool)
        keep[at + 1] = False
        seq = seq[keep]
        live = np.flatnonzero(stays[keep][:-1])
        live = live[(seq[live] != END) & (seq[live + 1] != END)]
    g = Grammar(vocabulary, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), np.concatenate(lengths).astype(np.uint32) if lengths else np.zeros(0, np.uint32), seq)
    doc_ends = np.searchsorted(np.cumsum(symbol_lengths(g, seq)), ends) + 1
    return g, doc_ends


def symbol_lengths(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    out = np.ones(symbols.size, np.int64)
    new = symbols >= g.first_new
    out[new] = g.lengths[symbols[new] - g.first_new]
    return out


def expand(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids that a stretch of the sequence stands for."""
    if symbols.size <= len(g.rules):
        return _expanded(g, symbols)
    # Every symbol is expanded once, and looked up.
    n = g.first_new + len(g.rules)
    table, width = _expanded(g, np.arange(n)), symbol_lengths(g, np.arange(n))
    first, size = (np.cumsum(width) - width)[symbols], width[symbols]
    ends = np.cumsum(size)
    return table[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)]


def _expanded(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    out = symbols.astype(np.uint32)
    while (new := out >= g.first_new).any():
        step = np.where(new, 2, 1)
        at = np.cumsum(step) - step
        wide = np.empty(int(step.sum()), np.uint32)
        wide[at[~new]] = out[~new]
        pair = g.rules[out[new] - g.first_new]
        wide[at[new]], wide[at[new] + 1] = pair[:, 0], pair[:, 1]
        out = wide
    return out


def ids_between(g: Grammar, start: int, stop: int) -> np.ndarray:
    """ids[start:stop] of a shard; expands only the symbols that cover them."""
    ends = np.cumsum(symbol_lengths(g, g.sequence))
    lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop)) + 1
    skip = start - (int(ends[lo - 1]) if lo else 0)
    return expand(g, g.sequence[lo:hi])[skip : skip + stop - start]


SHARD = "bucket int, shard int, start_in_bucket long, n_docs int, n_ids long, first_new int, rules binary, lengths binary, width int, sequence binary, doc_at binary, doc_ids array<string>"


def write(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every text and write the shards to path."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # Ranges of (id, hash) split ids that many rows have; texts take no part in finding them.
    placed = own.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    placed = placed.select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SHARD.split(", "))])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path)
        size = t.library.get_vocab_size()
        end = np.array([END], "<u4").tobytes()
        held: list[bytes] = []
        names: list[str | None] = []
        bucket, shard, start, count = TaskContext.get().partitionId(), 0, 0, 0

        def flush() -> pa.RecordBatch:
            lens = np.array([len(x) // 4 for x in held])
            g, doc_ends = compress(np.frombuffer(b"".join(held), "<u4"), np.cumsum(lens), size)
            width = 2 if g.first_new + len(g.rules) <= 65_536 else 4
            row = (bucket, shard, start, len(held), int(lens.sum()), g.first_new, g.rules.astype("<u4").tobytes(), g.lengths.astype("<u4").tobytes(), width, g.sequence.astype(f"<u{width}").tobytes(), np.append(0, doc_ends).astype("<u4").tobytes(), list(names))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema)

        for b in batches:
            for name, x in zip(b.column("doc_id").to_pylist(), t.encode_all(b.column("text").cast(pa.string()))):
                ids = x + end
                if held and count + len(ids) // 4 > shard_ids:
                    yield flush()
                    shard, start = shard + 1, start + count
                    held, names, count = [], [], 0
                held.append(ids)
                names.append(name)
                count += len(ids) // 4
        if held:
            yield flush()

    placed.mapInArrow(shards, SHARD).write.parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, bucket_start): ids in all buckets before. There is a bucket for each partition of the writing job at most."""
    sizes = spark.read.schema(SHARD).parquet(path).groupBy("bucket").agg(F.sum("n_ids").alias("n")).orderBy("bucket").collect()
    rows, base = [], 0
    for r in sizes:
        rows.append((r["bucket"], base))
        base += r["n"]
    return spark.createDataFrame(rows, "bucket int, bucket_start long")


def _grammar(r) -> Grammar:
    return Grammar(r.first_new, np.frombuffer(r.rules, "<u4").reshape(-1, 2), np.frombuffer(r.lengths, "<u4"), np.frombuffer(r.sequence, f"<u{r.width}"))


def _shards(spark: SparkSession, path: str) -> DataFrame:
    # A few shards at a time reach a worker: rows are large here.
    return spark.read.schema(SHARD).parquet(path).join(F.broadcast(starts(spark, path)), "bucket")


def read(spark: SparkSession, path: str, *, digest: bool = False, id_type: str = "long", only: list | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files, or of those with the ids in `only`, of whose shards only what
    covers them is expanded; digest: ids_crc32 in place of ids."""
    last = "ids_crc32 long" if digest else "ids binary"
    wanted = None if only is None else {None if x is None else str(x) for x in only}

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                g, names = _grammar(r), list(r.doc_ids)
                at = np.frombuffer(r.doc_at, "<u4")
                ends = np.append(0, np.cumsum(symbol_lengths(g, g.sequence)))[at]
                take = [k for k, x in enumerate(names) if wanted is None or x in wanted]
                if wanted is None:
                    data = expand(g, g.sequence).astype("<u4").tobytes()
                    parts = [data[4 * i : 4 * j] for i, j in zip(ends.tolist(), ends[1:].tolist())]
                else:
                    parts = [expand(g, g.sequence[at[k] : at[k + 1]]).astype("<u4").tobytes() for k in take]
                base = r.bucket_start + r.start_in_bucket
                yield pd.DataFrame({"doc_id": pd.Series([names[k] for k in take], dtype=object), "start": ends[:-1][take] + base, "n_tokens": np.diff(ends)[take], last.split()[0]: [zlib.crc32(x) if digest else x for x in parts]})

    shards = _shards(spark, path)
    if wanted is not None:
        some = F.arrays_overlap("doc_ids", F.array(*map(F.lit, sorted(x for x in wanted if x is not None))).cast("array<string>"))
        shards = shards.filter(F.coalesce(some, F.lit(True)))
    return shards.mapInPandas(documents, f"doc_id string, start long, n_tokens long, {last}").withColumn("doc_id", F.col("doc_id").cast(id_type))


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids): the ids from start to stop of all documents' ids, by shard; other shards aren't decoded."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                base = r.bucket_start + r.start_in_bucket
                lo, hi = max(start, base), min(stop, base + r.n_ids)
                yield pd.DataFrame({"start": [lo], "ids": [ids_between(_grammar(r), lo - base, hi - base).astype("<u4").tobytes()]})

    first = F.col("bucket_start") + F.col("start_in_bucket")
    return _shards(spark, path).filter((first < stop) & (first + F.col("n_ids") > start)).mapInPandas(parts, "start long, ids binary")
