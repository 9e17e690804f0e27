"""Secret scans: three fixed rules, and probabilistic automata that are inferred from what the rules find.

The rules' matches are labelled credentials. For each kind a prefix tree of their character classes is built and its
states are merged where a Hoeffding test finds no significant difference in what follows (ALERGIA), which leaves a small
probabilistic automaton; another one is inferred from ordinary tokens. These are tokens that come after different words,
wherever that is, which leaves out a secret that is copied with its document; and numbers whose form does. Every candidate
token of every text that no rule has found is scored: the mean log-likelihood ratio, a symbol, of the likeliest kind against
the ordinary automaton. From the threshold on, which lies between the scores of ordinary tokens and those of credentials that
the automata weren't fitted on, it counts as a secret of kind `format`, however many do.

The automata are fitted on bounded samples (SAMPLE strings of each kind, ORDINARY tokens, chosen by hash); all texts are
scanned whole, all candidates of SHORTEST characters or more and all ordinary tokens scored.

Cases: null and empty texts have no spans; repeated rows are scanned one by one; without labelled credentials or ordinary
tokens no candidate is added; an empty table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import inf, log, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("assign", "access", "hex", "format")
SAMPLE, ORDINARY, ALPHA = 500, 4000, 0.01
SHORTEST = 6
#: Scores that a worker keeps, and strings that it gathers before it gives them out, about.
KNOWN = 1 << 16
#: Characters before a token that tell its places apart.
BEFORE = 24

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters or more
NAMES = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
_classes = str.maketrans({c: "d" if c <= "9" else "u" if c <= "Z" else "h" if c <= "f" else "l" for c in string.digits + string.ascii_letters})


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, credential) of the rules' matches, in order."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens that overlap no span."""
    found = [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text) if m.end() - m.start() >= SHORTEST]
    if not spans:
        return found
    out, k, reach = [], 0, 0
    for x in found:
        while k < len(spans) and spans[k][0] < x[1]:
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= x[0]:
            out.append(x)
    return out


def symbols(token: str) -> str:
    """Character classes: d digit, h a-f, l other lower case, u upper case; other characters stand for themselves."""
    return token.translate(_classes)


@dataclass
class State:
    total: int = 0
    end: int = 0
    count: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A deterministic probabilistic automaton, merged from the prefix tree of sample strings."""

    FLOOR = 1e-4

    def __init__(self, sample: list[str]) -> None:
        self.states = [State()]
        for s in sample:
            at = self.states[0]
            at.total += 1
            for c in s:
                at.count[c] = at.count.get(c, 0) + 1
                if c not in at.to:
                    at.to[c] = len(self.states)
                    self.states.append(State())
                at = self.states[at.to[c]]
                at.total += 1
            at.end += 1
        self._merge()
        self.logs = {i: {c: log(max(self.FLOOR, n / s.total)) for c, n in s.count.items()} | {"": log(max(self.FLOOR, s.end / s.total))} for i, s in enumerate(self.states) if s.total}

    def _differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > sqrt(0.5 * log(2 / ALPHA)) * (1 / sqrt(n1) + 1 / sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            i, j = todo.pop()
            x, y = self.states[i], self.states[j]
            if self._differ(x.total, x.end, y.total, y.end):
                return False
            for c in x.count.keys() | y.count.keys():
                if self._differ(x.total, x.count.get(c, 0), y.total, y.count.get(c, 0)):
                    return False
                if c in x.to and c in y.to and x.to[c] != y.to[c]:
                    todo.append((x.to[c], y.to[c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree b to state a."""
        todo = [(a, b)]
        while todo:
            i, j = todo.pop()
            x, y = self.states[i], self.states[j]
            x.total, x.end = x.total + y.total, x.end + y.end
            for c, n in y.count.items():
                x.count[c] = x.count.get(c, 0) + n
                if c in x.to:
                    todo.append((x.to[c], y.to[c]))
                else:
                    x.to[c] = y.to[c]
            y.total = 0

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = sorted({(i, c, t) for i in red for c, t in self.states[i].to.items() if t not in red}, key=lambda x: (-self.states[x[2]].total, x))
            if not blue:
                return
            i, c, t = blue[0]
            for r in red:
                if self._compatible(r, t):
                    self.states[i].to[c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)

    def likelihood(self, s: str) -> float:
        """Mean log-likelihood, a symbol, the end counted as one."""
        at, total, floor = 0, 0.0, log(self.FLOOR)
        for k, c in enumerate(s):
            logs = self.logs.get(at)
            if logs is None or c not in logs:
                return (total + floor * (len(s) - k + 1)) / (len(s) + 1)
            total += logs[c]
            at = self.states[at].to[c]
        return (total + self.logs.get(at, {}).get("", floor)) / (len(s) + 1)


@dataclass
class Scanner:
    kinds: list[Automaton]
    ordinary: Automaton | None
    threshold: float
    known: dict[str, float] = field(default_factory=dict)

    def score(self, token: str) -> float:
        if not self.kinds or self.ordinary is None:
            return -inf
        s = symbols(token)
        value = self.known.get(s)
        if value is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            value = self.known[s] = max(a.likelihood(s) for a in self.kinds) - self.ordinary.likelihood(s)
        return value

    def spans(self, base: list[tuple[int, int, int]], found: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
        """(start, kind's number, end) of the rules' spans and of the candidates that count as secrets."""
        return sorted([*base, *((a, 3, b) for a, b, x in found if self.score(x) >= self.threshold)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k, x, lo, hi): the distinct credentials of the rules' kinds, and candidates as kind 3, with the smallest and the largest
    hash of the characters before them."""

    def frame(seen: dict[tuple[int, str], tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame([(k, x, lo, hi) for (k, x), (lo, hi) in seen.items()], columns=["k", "x", "lo", "hi"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[tuple[int, str], tuple[int, int]] = {}
            for value in b["text"].tolist():
                spans = base_spans(value)
                for _, k, _, x in spans:
                    seen[k, x] = (0, 0)
                for a, _, x in candidates(value, spans):
                    h = zlib.crc32(value[max(0, a - BEFORE) : a].encode("utf-8", "replace"))
                    lo, hi = seen.get((3, x), (h, h))
                    seen[3, x] = (min(lo, h), max(hi, h))
                if len(seen) >= KNOWN:
                    yield frame(seen)
                    seen.clear()
            yield frame(seen)

    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = own.mapInPandas(rows, "k int, x string, lo long, hi long")
    return materialize(found.groupBy("k", "x").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "strings")


def fit(docs: DataFrame, text: str = "text") -> Scanner:
    """Infer the automata from bounded samples of what scan() has found, and the threshold from all ordinary tokens."""
    scanned = scan(docs, text)
    kinds = []
    held: list[str] = []
    for k in range(3):
        sample = [r["x"] for r in scanned.filter(F.col("k") == k).orderBy(F.xxhash64("x"), "x").limit(SAMPLE).collect()]
        if len(sample) >= 8:
            kinds.append(Automaton([symbols(x) for i, x in enumerate(sample) if i % 4]))
            held += sample[::4]
    tokens = scanned.filter("k = 3")
    words = tokens.filter("lo < hi").select("x")
    numbers = tokens.filter("x not rlike '[A-Za-z]'").withColumn("form", F.regexp_replace("x", "[0-9]", "d"))
    forms = numbers.groupBy("form").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).filter("a < b").select(F.col("form").alias("f"))
    numbers = numbers.filter("lo = hi").join(forms, F.col("form") == F.col("f"), "left_semi").select("x")
    tokens = materialize(words.unionByName(numbers), "ordinary")
    ordinary = [r["x"] for r in tokens.orderBy(F.xxhash64("x"), "x").limit(ORDINARY).collect()]
    if not kinds or len(ordinary) < 8:
        return Scanner([], None, inf)
    scanner = Scanner(kinds, Automaton([symbols(x) for x in ordinary]), inf)

    @F.pandas_udf("double")
    def scored(values: pd.Series) -> pd.Series:
        return values.map(scanner.score)

    top = tokens.agg(F.percentile_approx(scored("x"), 0.998, 100_000).alias("top")).first()["top"]
    low = sorted(map(scanner.score, held))
    # Between nearly all ordinary tokens and nearly all credentials; never at or below what an ordinary one may score.
    return Scanner(kinds, scanner.ordinary, max(top + 0.05, (top + low[int(0.02 * (len(low) - 1))]) / 2))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format) of every row."""
    scanner = fit(docs, text)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, value in zip(b["doc_id"].tolist(), b["text"].tolist()):
                found = base_spans(value)
                base = [x[:3] for x in found]
                every = scanner.spans(base, candidates(value, found))
                out.append((name, *(sum(1 for x in base if x[1] == k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = own.mapInPandas(rows, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in the text replaced by a mark; overlapping spans by one."""
    scanner = fit(docs, text)

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _clean(v, scanner, mark), na_action="ignore")

    return docs.withColumn(text, clean(F.col(text)))


def _clean(value: str, scanner: Scanner, mark: str) -> str:
    base = base_spans(value)
    parts, at = [], 0
    for a, _, b in scanner.spans([x[:3] for x in base], candidates(value, base)):
        if a >= at:
            parts += [value[at:a], mark]
        at = max(at, b)
    return "".join(parts) + value[at:] if parts else value
