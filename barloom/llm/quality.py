"""Quality rules: plain counts of each text and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials over the buckets are counted:
the target from trusted documents, the raw one from all documents. A text's score is the mean over its n-grams of
log p_target - log p_raw. A document is kept if no base rule fails and its score reaches the threshold, which is found
once from labelled rows and then applied alike to every document. All is DataFrame work; the driver sees the bucket
counts (a fixed number) and the scores of a bounded sample.

Cases: null and blank texts have no words, score 0 and fail the base rule; null or unlabelled ids have a score like any
other; repeated rows are judged one by one; an empty table gives an empty result; without labels of both kinds the
threshold is minus infinity, so that only base rules reject. Other columns of the input play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

BUCKETS = 1 << 14
#: Labelled rows of each class that the model may be fitted on, at most.
SAMPLE = 20_000
SMOOTH = 2.0
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    threshold: float


def _pairs(a: str, length: Column, shift: int) -> Column:
    """Hash of a[i] and a[i + shift] for the first `length` positions."""
    n = F.greatest(length, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, 1 + shift, n), lambda x, y: F.xxhash64(x, y))


def _grams(docs: DataFrame, text: str) -> DataFrame:
    """Add __words, __h1 and __h2: words, hashes of words and of word pairs."""
    out = docs.withColumn("__words", words(F.col(text)))
    out = out.withColumn("__h1", F.transform("__words", lambda w: F.xxhash64(w)))
    return out.withColumn("__h2", _pairs("__h1", F.size("__h1") - 1, 1))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def _score(model: QualityModel) -> Column:
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in model.weights)), ",").cast("array<double>")
    both = F.concat("__h1", "__h2")
    total = F.aggregate(both, F.lit(0.0), lambda a, h: a + F.get(table, F.pmod(h, F.lit(len(model.weights))).cast("int")))
    return F.when(F.size("__h1") > 0, F.round(total / F.size(both), 9)).otherwise(F.lit(0.0))


def measure(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Add a struct column __q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    out = _grams(docs, text)
    n = F.size("__words")
    out = out.withColumn("__h4", _pairs("__h2", n - 3, 2))
    out = out.withColumn("__h8", _pairs("__h4", n - (WINDOW - 1), 4))
    keyed = F.sort_array(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("__k", F.when(F.size(F.array_distinct("__h8")) < F.size("__h8"), keyed).otherwise(none))
    met = lambda x, i: x["h"].eqNullSafe(F.get("__k", i - 1)["h"]) | x["h"].eqNullSafe(F.get("__k", i + 1)["h"])
    out = out.withColumn("__p", F.sort_array(F.transform(F.filter("__k", met), lambda x: x["i"])))
    gaps = F.zip_with(F.slice("__p", 1, F.size("__p") - 1), F.slice("__p", 2, F.size("__p") - 1), lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long"))
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    out = out.withColumn("__lines", lines)
    # A generator, as a filter on its result isn't pushed below it, where it would repeat all of the above in each use.
    out = out.select(
        "*",
        F.explode_outer(F.array(F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            F.regexp_count(value, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.size("__p") > 0, _sum(gaps) + WINDOW).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
            _score(model).alias("score"),
        ))).alias("__q"),
    ).drop("__words", "__h1", "__h2", "__h4", "__h8", "__k", "__p", "__lines")
    q = F.col("__q")
    failed = (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT_PERCENT)
    out = out.withColumn("__q", q.withField("base_failed", failed))
    return out.withColumn("__q", F.col("__q").withField("kept", ~F.col("__q")["base_failed"] & (F.col("__q")["score"] >= F.lit(model.threshold))))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS, sample: int = SAMPLE) -> QualityModel:
    """Count both multinomials and find the threshold. labels: (doc_id, quality 0 or 1); at most `sample` rows a class."""
    own = labels.select(F.col(id_col).alias("__id"), F.col("quality").alias("__y")).filter("__id is not null and __y in (0, 1)")
    own = own.groupBy("__id").agg(F.min("__y").alias("__y"))
    picked = [own.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample) for y in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # 2 * sample rows at most
    base = docs.select(F.col(id_col).alias("__doc"), F.col(text).alias("__text"))
    flagged = base.join(picked, F.col("__doc") == F.col("__id"), "left")
    grams = _grams(flagged, "__text").select("__y", F.explode_outer(F.transform(F.concat("__h1", "__h2"), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))).alias("g"))
    counts = grams.groupBy("g").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("__y") == 1).alias("target")).collect()  # buckets rows
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        if r["g"] is None:  # of texts without words
            continue
        raw[r["g"]], target[r["g"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw) + SMOOTH * buckets, sum(target) + SMOOTH * buckets
    if not sum(target):
        return QualityModel((0.0,) * buckets, -inf)
    weights = tuple(log((t + SMOOTH) / n_target) - log((r + SMOOTH) / n_raw) for t, r in zip(target, raw))
    model = QualityModel(weights, -inf)
    scored = measure(base.join(picked, F.col("__doc") == F.col("__id")), model, "__text")
    return QualityModel(weights, _threshold([(r["s"], r["__y"]) for r in scored.select(F.col("__q")["score"].alias("s"), "__q.base_failed", "__y").collect() if not r["base_failed"]]))


def _threshold(scored: list[tuple[float, int]]) -> float:
    """The cut with the best balanced accuracy, in the middle of the gap it falls in; -inf without both classes."""
    good, bad = sum(y for _, y in scored), sum(1 - y for _, y in scored)
    if not good or not bad:
        return -inf
    scored = sorted(scored)
    best, cut, below_good, below_bad = -1.0, -inf, 0, 0
    for i, (s, y) in enumerate(scored):
        here = (good - below_good) / good + below_bad / bad
        if here > best and (i == 0 or scored[i - 1][0] < s):
            best, cut = here, s if i == 0 else (s + scored[i - 1][0]) / 2
        below_good, below_bad = below_good + y, below_bad + 1 - y
    return cut


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns that they had."""
    return measure(docs, fit(docs, labels)).filter(F.col("__q")["kept"]).drop("__q")
