"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of table rows to which the word and its beginnings of 4 to 7 letters are hashed, so that
inflected and unseen forms are met; filters of several widths run over the word sequence and each keeps its largest
response anywhere in the text; a logistic layer weighs these. As max pooling passes a gradient to one position of each
filter only, a step touches few rows.

It is trained on every labelled row that may be learnt from, whole texts each. The rows lie in shards of about SHARD rows; in a
round each task takes the steps of its shard from the weights of the round before, and Spark averages the weights, each table
row over the shards that moved it, so that words that few shards have aren't thinned out. Few rows are one shard with more epochs.

Scoring is one pass over all texts. A filter over embeddings is a sum of one product for each of its places; a worker
remembers the products of the words it has met (a bounded number), and a text needs look-ups, sums and maxima only.

Thresholds by language: a text's language is told from its own function words, never from a column. A quarter of the labelled
rows, by hash, isn't trained on. All of it is scored and counted by language and logit in steps of 1 / FINE; the cut of each language's
best F1 is found from these counts, and scores are shifted so that it falls on 0.3, the common decision point; languages with
few examples take the shift of all.

Cases: where the other three quarters have one label only, every row serves both; null, empty and blank texts score like a text without any response; null ids are never trained on; repeated rows
score alike; without labels of both kinds every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROWS, WIDE, FILTERS, WIDTHS = 1 << 17, 12, 8, (1, 2, 3)
BEGINNINGS = (4, 5, 6, 7)
STEPS, MOST_EPOCHS, ROUNDS, RATE, SEED = 16_000, 12, 2, 0.1, 7
#: Rows of a shard, about, and words from which on a task takes the steps of what it has read; no row is left out.
SHARD, WORDS = 4096, 8_000_000
#: Steps of a logit in which held rows are counted.
FINE, WIDEST = 256, 30
DECISION = 0.3
REMEMBERED = 250_000

# A filter's places, width by width and place by place: number of the filter, and of the place.
SIZE = FILTERS * len(WIDTHS)
OWNER = np.array([FILTERS * g + f for g, w in enumerate(WIDTHS) for _ in range(w) for f in range(FILTERS)])
PLACE = np.array([k for w in WIDTHS for k in range(w) for _ in range(FILTERS)])
#: The layers above the table, laid into rows like its own.
DENSE = -(-(WIDE * OWNER.size + 2 * SIZE + 1) // WIDE)

# Function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with be by at this have from or an",
    "de": "der die und das ist nicht ein eine mit den von zu auf für im dem des sich auch es",
    "fr": "le la les et des est dans une pour que qui sur pas avec au du ce il ne en",
    "es": "el los las y que del se por con una para es su al lo como más o un la",
}
LANGUAGE = {w: k for k, ws in reversed(FUNCTION_WORDS.items()) for w in ws.split()}
_SHARED = {w for w in LANGUAGE if sum(w in ws.split() for ws in FUNCTION_WORDS.values()) > 1}
NAMES = sorted(FUNCTION_WORDS)

_TOLD = {w: NAMES.index(k) for w, k in LANGUAGE.items() if w not in _SHARED}

_split = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Table rows of a word and of its beginnings, which stand after a ^; row 0 is empty."""
    whole = word.encode("utf-8", "replace")
    out, c, at = [1 + zlib.crc32(whole) % (ROWS - 1)], zlib.crc32(b"^"), 0
    for k in BEGINNINGS:
        if len(word) > k:  # the checksum goes on from the beginning before
            part = whole[at:k] if len(whole) == len(word) else word[at:k].encode("utf-8", "replace")
            c, at = zlib.crc32(part, c), k
            out.append(1 + c % (ROWS - 1))
        else:
            out.append(0)
    return out


def tokens(text: str | None) -> tuple[list[str], int]:
    """(words, number of the language)."""
    found = _split.findall(text.lower()) if text else []
    votes = [0] * len(NAMES)
    for w in filter(_TOLD.__contains__, found):
        votes[_TOLD[w]] += 1
    return found, int(np.argmax(votes)) if any(votes) else -1


class Model:
    def __init__(self, w: Weights) -> None:
        self.table, self.columns = w.table, np.ascontiguousarray(w.places.T)  # one column for each filter's place
        self.bias, self.weights, self.constant = w.bias, w.weights, float(w.constant[0])
        self.shifts: dict[int, float] = {}
        self._words: _Products | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": None}

    def pooled(self, words: list[str]) -> np.ndarray:
        if self._words is None:
            self._words = _Products(self)
        pad = [0] * (max(WIDTHS) - 1)
        x = self._words.rows(pad, words)
        parts, at = [], 0
        for w in WIDTHS:
            n = len(x) - w + 1
            total = x[:n, at : at + FILTERS].copy()
            for k in range(1, w):
                total += x[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
            parts.append(total.max(0))
            at += w * FILTERS
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def logit(self, words: list[str]) -> float:
        return float(self.pooled(words) @ self.weights + self.constant)

    def score(self, text: str | None) -> float:
        found, language = tokens(text)
        z = self.logit(found) + self.shifts.get(language, self.shifts.get(-1, 0.0))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


class _Products:
    """The products of the words met so far, in rows by a word's number; row 0 stands before and after a text."""

    def __init__(self, model: Model) -> None:
        self.model, self.number = model, {}
        self.held = np.zeros((REMEMBERED, model.columns.shape[1]), np.float32)

    def products(self, words: list[str]) -> np.ndarray:
        """A row for each word, by sums that don't depend on the other words' number."""
        x = self.model.table[[features(w) for w in words]].sum(1)
        out = x[:, :1] * self.model.columns[0]
        for k in range(1, x.shape[1]):
            out += x[:, k : k + 1] * self.model.columns[k]
        return out

    def rows(self, pad: list[int], words: list[str]) -> np.ndarray:
        new = set(words).difference(self.number)
        if len(self.number) + len(new) >= REMEMBERED:
            self.number.clear()
            new = set(words)
        if len(new) >= REMEMBERED:
            none = np.zeros((len(pad), self.held.shape[1]), np.float32)
            return np.concatenate([none, self.products(words), none])
        if new:
            at = 1 + len(self.number)
            self.held[at : at + len(new)] = self.products([*new])
            self.number.update(zip(new, range(at, at + len(new))))
        return self.held[[*pad, *map(self.number.__getitem__, words), *pad]]


class Weights:
    """All weights and their sums of squared gradients (AdaGrad), as rows of WIDE numbers: the table's, then the layers above it."""

    def __init__(self, values: np.ndarray, squares: np.ndarray) -> None:
        self.values, self.squares = values, squares
        (self.table, self.places, self.bias, self.weights, self.constant), self._sums = self._parts(values), self._parts(squares)

    @staticmethod
    def _parts(x: np.ndarray) -> list[np.ndarray]:
        """Views: the table, a row for each filter's place, then bias, weight and constant of the logistic layer."""
        flat, n = x[ROWS:].reshape(-1), WIDE * OWNER.size
        return [x[:ROWS], flat[:n].reshape(-1, WIDE), flat[n : n + SIZE], flat[n + SIZE : n + 2 * SIZE], flat[n + 2 * SIZE : n + 2 * SIZE + 1]]

    @staticmethod
    def first() -> Weights:
        rng = np.random.default_rng(SEED)
        w = Weights(np.zeros((ROWS + DENSE, WIDE), np.float32), np.full((ROWS + DENSE, WIDE), 1e-6, np.float32))
        w.table[1:] = rng.normal(0, 0.1, (ROWS - 1, WIDE))
        w.places[:] = np.concatenate([rng.normal(0, 1 / math.sqrt(WIDE * k), (k * FILTERS, WIDE)) for k in WIDTHS])
        w.weights[:] = rng.normal(0, 0.3, SIZE)
        return w

    def copy(self) -> Weights:
        return Weights(self.values.copy(), self.squares.copy())

    def step(self, ids: np.ndarray, y: int, up: float) -> None:
        """One text's step. ids: table rows of each word, with empty words before and after; up: weight of the label."""
        x = self.table[ids].sum(1)
        products, at, tops, values = x @ self.places.T, 0, [], []
        for w in WIDTHS:
            n = len(x) - w + 1
            out = products[:n, at : at + FILTERS]
            for k in range(1, w):
                out = out + products[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
            top = out.argmax(0)
            tops.append(top)
            values.append(out[top, np.arange(FILTERS)])
            at += w * FILTERS
        h = np.maximum(np.concatenate(values) + self.bias, 0)
        z = float(h @ self.weights + self.constant[0])
        delta = np.float32((1 / (1 + math.exp(-min(30.0, max(-30.0, z)))) - y) * up)
        if abs(delta) < 1e-3:
            return
        back = delta * self.weights * (h > 0)
        for own, sums, by in zip((self.weights, self.constant, self.bias), (self._sums[3], self._sums[4], self._sums[2]), (delta * h, delta, back)):
            sums += by**2
            own -= RATE * by / np.sqrt(sums)
        used = np.flatnonzero(back[OWNER])
        if not used.size:
            return
        own, by = np.concatenate(tops)[OWNER[used]] + PLACE[used], back[OWNER[used], None]
        move, turn = self.places[used] * by, x[own] * by
        self._sums[1][used] += turn**2
        self.places[used] -= RATE * turn / np.sqrt(self._sums[1][used])
        rows = ids[own].reshape(-1)
        order = np.argsort(rows, kind="stable")
        order = order[np.searchsorted(rows[order], 1) :]  # row 0 stays empty
        if not order.size:
            return
        rows, move = rows[order], move[order // ids.shape[1]]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        rows, move = rows[first], np.add.reduceat(move, first)  # what several places pass to one row is one gradient
        sums = self.squares[rows] + move**2
        self.squares[rows] = sums
        self.table[rows] -= RATE * move / np.sqrt(sums)


class _Words(dict):
    """word -> its number; the table rows of the words by number stand one after another."""

    def __init__(self) -> None:
        self.held = array("i", [0] * (1 + len(BEGINNINGS)))

    def __missing__(self, word: str) -> int:
        at = self[word] = 1 + len(self)
        self.held.extend(features(word))
        return at


def learn(weights: Weights, rows: Iterable[tuple[str, int]], up: tuple[float, float], epochs: int, seed: int) -> None:
    """Take the steps of (text, label) rows, in any number, in random order among about SHARD of them."""
    rng, pad = np.random.default_rng(seed), [0] * (max(WIDTHS) - 1)
    words, texts, size = _Words(), [], 0

    def steps() -> None:
        table = np.frombuffer(words.held, np.int32).reshape(-1, 1 + len(BEGINNINGS))
        for _ in range(epochs):
            for i in rng.permutation(len(texts)).tolist():
                ids, y = texts[i]
                weights.step(table[ids], y, up[y])

    for text, y in rows:
        texts.append((np.array([*pad, *map(words.__getitem__, _split.findall(text.lower())), *pad], np.int32), y))
        size += texts[-1][0].size
        if len(texts) >= 2 * SHARD or size >= WORDS or len(words) >= REMEMBERED:
            steps()
            words, texts, size = _Words(), [], 0
    steps()


def train(rows: DataFrame, n: int, positive: int) -> Weights:
    """Fit on all rows (__text, __y); n: how many there are, positive: of them with label 1."""
    spark, up = rows.sparkSession, (n / (2 * (n - positive)), n / (2 * positive))
    shards, epochs = max(1, round(n / SHARD)), min(MOST_EPOCHS, 1 + STEPS // n)
    rounds, local = (1, epochs) if shards == 1 else (max(ROUNDS, epochs), 1)
    weights, names = Weights.first(), [f"{c}{i}" for c in "vs" for i in range(WIDE)]
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((weights.values, weights.squares))  # a fixed size

        def shard(batches: Iterator[pd.DataFrame], sent=sent, k=k) -> Iterator[pd.DataFrame]:
            before = Weights(*sent.value)
            own, seen = before.copy(), False

            def read() -> Iterator[tuple[str, int]]:
                nonlocal seen
                for b in batches:
                    seen = seen or len(b) > 0
                    yield from zip(b["__text"], b["__y"].tolist())

            learn(own, read(), up, local, SEED + k)
            if seen:
                moved = np.flatnonzero((own.squares != before.squares).any(1) | (np.arange(ROWS + DENSE) >= ROWS))
                yield pd.DataFrame(np.concatenate([own.values[moved], own.squares[moved]], 1), columns=names).assign(row=moved)

        parts = rows.coalesce(shards).mapInPandas(shard, ", ".join(f"{c} float" for c in names) + ", row long")
        # ROWS + DENSE rows at most, whatever the input.
        mean = parts.groupBy("row").agg(*(F.avg(c).cast("float").alias(c) for c in names)).toArrow()
        at = mean["row"].to_numpy()
        found = np.stack([mean[c].to_numpy() for c in names], 1)
        weights.values[at], weights.squares[at] = found[:, :WIDE], found[:, WIDE:]
        sent.unpersist()
    return weights


def best_cut(bins: list[tuple[float, float, int, int]]) -> float:
    """The logit from which on F1 is largest, in the middle of its gap. bins: (lowest, highest logit, rows, rows with label 1)."""
    bins = sorted(bins, reverse=True)
    total = sum(b[3] for b in bins)
    best, cut, hit, n = -1.0, bins[0][0], 0, 0
    for i, (low, _, size, ones) in enumerate(bins):
        hit, n = hit + ones, n + size
        f1 = 2 * hit / (total + n)
        if f1 > best:
            best, cut = f1, (low + bins[i + 1][1]) / 2 if i + 1 < len(bins) else low - 1
    return cut


def shifts(rows: DataFrame, model: Model) -> dict[int, float]:
    """What is added to the logits of each language (-1: all others), from all rows (__text, __y)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, sent.value.logit(w)) for w, k in map(tokens, b["__text"])]
            yield pd.DataFrame({"k": [x[0] for x in found], "z": [x[1] for x in found], "y": b["__y"].to_numpy()})

    bins = rows.mapInPandas(logits, "k int, z double, y int").groupBy("k", F.floor(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), "z")) * FINE).alias("b"))
    # (2 * WIDEST * FINE + 1) * (languages + 1) rows at most.
    counted = bins.agg(F.min("z").alias("low"), F.max("z").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).collect()
    goal, out, every = math.log(DECISION / (1 - DECISION)), {}, {}
    for r in counted:
        low, high, n, ones = every.get(r["b"], (math.inf, -math.inf, 0, 0))
        every[r["b"]] = min(low, r["low"]), max(high, r["high"]), n + r["n"], ones + r["ones"]
    for language in (-1, *range(len(NAMES))):
        own = [*every.values()] if language == -1 else [(r["low"], r["high"], r["n"], r["ones"]) for r in counted if r["k"] == language]
        if sum(b[3] for b in own) >= (1 if language == -1 else 10):
            out[language] = goal - best_cut(own)
    return {-1: goal} | out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> Model | None:
    """Train on all labelled rows whose crc32(id as text) mod 4 isn't 2."""
    told = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(4)) != 2
    own = labels.select(F.col(id_col).alias("__id"), F.col("toxic").cast("int").alias("__y")).filter("__id is not null and __y in (0, 1)").filter(told("__id"))
    own = own.groupBy("__id").agg(F.max("__y").alias("__y"))
    rows = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text), F.lit("")).alias("__text")).filter(told("__doc")).join(own.hint("merge"), F.col("__doc") == F.col("__id"))
    held = F.pmod(F.xxhash64("__id"), F.lit(4)) == 0
    rows = materialize(rows.select("__text", "__y", held.alias("__held")), "labelled")
    sizes = {(r["__held"], r["__y"]): r["count"] for r in rows.groupBy("__held", "__y").count().collect()}
    fitted, rest = rows.filter("not __held"), rows.filter("__held")
    n = [sizes.get((False, y), 0) for y in (0, 1)]
    if not all(n):
        fitted = rest = rows
        n = [n[y] + sizes.get((True, y), 0) for y in (0, 1)]
    if not all(n):
        return None
    model = Model(train(fitted.select("__text", "__y"), sum(n), n[1]))
    model.shifts = shifts(rest.select("__text", "__y"), model)
    return model


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: ROWS * WIDE numbers and few more

    def scores(texts: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series([m.score(t) if m else 0.0 for t in texts], dtype=float)

    name = F.col(id_col).cast("string")
    held = F.coalesce(F.pmod(F.crc32(name.cast("binary")), F.lit(4)) == 2, F.lit(False))
    out = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.pandas_udf(scores, "double")(F.col(text)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= DECISION, 1).otherwise(0))
