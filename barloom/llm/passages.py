"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds: hashes of K-word runs of each text (lower-cased words), thinned by winnowing: the smallest hash of every WINDOW
   neighbouring ones, so that an exact repeat of K + WINDOW - 1 words always shares one.
2. Join: seeds are range-partitioned and sorted by (seed, document, place), which splits a seed of any frequency over tasks. In
   that order each occurrence is matched to the seed's first document, its home, and to the two documents before it, so that
   matches grow with the text and not with the square of a seed's frequency, and documents that hold parts of a passage don't hide
   those that hold all of it. Where a seed goes on in the next partition, its home is carried over.
3. Runs: where seeds are shared, runs of RUN words are hashed, thinned by RUN_WINDOW and joined likewise, to their homes only.
   So an exact repeat of RUN + RUN_WINDOW - 1 words always meets a document that holds RUN of them at a stretch.
4. Chain: the matches of a document with each other one are merged along diagonals, and the pieces are chained in order
   in both texts; a Fenwick tree over places gives the best predecessor, whose gap costs its length in both texts. A chain whose
   matches alone make it a passage stands for the chains with other documents that lie within it.
5. Align: pieces of a chain are extended on both ends, gaps between them aligned by longest common subsequence, and what
   spans at least MIN_WORDS words with at least IDENTITY equal ones is a passage. A chain that isn't one as a whole is
   split between pieces into the passages that hold most equal words. Passages within another one of a document go.

Every document but the first that holds a passage thus has a row for it, with a document of smaller id that holds it too;
copies aren't expanded into all pairs.

Cases: null, empty and short texts have no seeds; rows with null ids take no part; repeated rows count once; very long texts
are worked on by themselves; other columns play no part; repeats inside one document aren't reported; an empty table gives an
empty result. A passage without an exact run of RUN words is missed only if for nearly all of its seeds the first and the two
preceding holders are other documents, which hold too little of it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions
from .hashing import hashed, mixed, powers, sums_of, winnowed

K, WINDOW = 6, 10
#: The words of a run, as many as a passage has at least.
RUN, RUN_WINDOW = 45, 6
#: Words that a chain must span to be aligned, and a passage to be reported; share of equal words; price of a gap's word.
CHAIN_WORDS, MIN_WORDS, IDENTITY, GAP = 12, 45, 0.7, 0.1
#: What an equal and another word are worth to an extension, which so never lowers a passage's share below IDENTITY, and how
#: much worse than its best it may get.
EQUAL, OTHER, DROP = 3, -7, 42


def seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places in words) of the winnowed seeds of a text's word hashes."""
    total = mixed(sums_of(h, K))
    at = winnowed(total, WINDOW)
    return total[at].view(np.int64), at.astype(np.int32)


def runs(h: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the thinned runs of RUN words, all of which lie near shared seeds (places).

    In an exact repeat every word is in a window of K-word runs whose smallest one both texts have, so near is that far.
    """
    n = h.size - RUN + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    steps = np.zeros(h.size + 1, np.int64)
    reach = K + WINDOW
    np.add.at(steps, np.maximum(shared - reach, 0), 1)
    np.add.at(steps, np.minimum(shared + reach + K, h.size), -1)
    near = np.append(0, np.cumsum(np.cumsum(steps[:-1]) > 0))
    up, down = powers(1 << h.size.bit_length())
    sums = np.append(np.uint64(0), np.cumsum(h * up[: h.size]))
    total = mixed((sums[RUN:] - sums[:-RUN]) * down[:n], 0x9E3779B97F4A7C15)
    within = near[RUN:] - near[:-RUN] == RUN
    total[~within] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = winnowed(total, RUN_WINDOW)
    at = at[within[at]]
    return total[at].view(np.int64), at.astype(np.int32)


def _rows(docs: Iterable[int], found: Iterable[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    found = list(found)
    if not found:
        return pd.DataFrame({"seed": np.zeros(0, np.int64), "doc": np.zeros(0, np.int64), "at": np.zeros(0, np.int32)})
    sizes = [x[0].size for x in found]
    return pd.DataFrame({"seed": np.concatenate([x[0] for x in found]), "doc": np.repeat(np.fromiter(docs, np.int64), sizes), "at": np.concatenate([x[1] for x in found])})


def _seed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield _rows(b["doc_id"], map(seeds, hashed(list(b["text"]))))


def _run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield _rows(b["doc_id"], (runs(np.frombuffer(w, np.uint32).astype(np.uint64), np.asarray(s, np.int64)) for w, s in zip(b["words"], b["places"])))


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "words": [h.astype(np.uint32).tobytes() for h in hashed(list(b["text"]))]})


# Kinds of rows of a seed: an occurrence in the home's own document, one elsewhere, a match with a document before, a
# partition's first and last seed.
HELD, MET, BEFORE, EDGE = range(4)
MATCH = "seed long, doc long, at int, other long, other_at int, kind byte"


def _matched(batches: Iterator[pd.DataFrame], neighbours: bool) -> Iterator[pd.DataFrame]:
    """Matches among rows sorted by (seed, doc, at): a document's k-th occurrence with the other one's k-th or last, so that copies of
    texts that repeat themselves match in order. What follows a batch needs the last seed's occurrences in four documents at most."""
    held = np.zeros((0, 3), np.int64)
    told = first = True  # whether the held seed's home has been given out; whether no row has been seen

    def rows(x: np.ndarray, i: np.ndarray, j: np.ndarray, kind: int) -> list[np.ndarray]:
        return [x[i, 0], x[i, 1], x[i, 2], x[j, 1], x[j, 2], np.full(len(i), kind)]

    for b in batches:
        if not len(b):
            continue
        old = len(held)
        x = np.concatenate([held, np.stack([b["seed"].to_numpy(np.int64), b["doc"].to_numpy(np.int64), b["at"].to_numpy(np.int64)], 1)])
        x = x[np.append(True, (x[1:] != x[:-1]).any(1))]  # repeated rows of a document
        i = np.arange(len(x))
        new = np.ones(len(x), bool)
        new[1:] = x[1:, 0] != x[:-1, 0]
        turn = new.copy()  # another document
        turn[1:] |= x[1:, 1] != x[:-1, 1]
        starts = np.flatnonzero(turn)
        ends = np.append(starts[1:], len(x))
        turns = np.cumsum(turn) - 1  # the number of a row's document, in order
        home_turn = turns[np.maximum.accumulate(np.where(new, i, 0))]
        home = starts[home_turn]

        def nth(t: np.ndarray, f: np.ndarray) -> np.ndarray:
            """The occurrences in turns t that those in rows f are matched to."""
            return np.minimum(starts[t] + f - starts[turns[f]], ends[t] - 1)

        shared = np.zeros(len(x), bool)  # homes of seeds that two documents have
        shared[home[turns > home_turn]] = True
        tell = new & shared
        if old:
            tell[0] &= not told
        out = [rows(x, f := np.flatnonzero(tell), f, HELD)]
        fresh = (i >= old) & (i != home)
        out.append(rows(x, f := np.flatnonzero(fresh & (turns == home_turn)), home[f], HELD))
        for back in (0, 1, 2) if neighbours else (0,):  # the home, and documents before short of it
            f = np.flatnonzero(fresh & (turns - back > home_turn))
            out.append(rows(x, f, nth(turns[f] - back if back else home_turn[f], f), BEFORE if back else MET))
        if first:
            z = np.zeros(1, np.int64)
            out += [rows(x, z, z, EDGE), rows(x, z, z, HELD)]
            first = False
        top = int(home[-1])
        told = bool(shared[top]) or (told if old and top == 0 else False)
        near = starts[max(int(home_turn[-1]), int(turns[-1]) - 2)]
        held = x[(turns == home_turn[-1]) | (i >= near)]
        yield _frame(out)
    if len(held):
        z = np.zeros(1, np.int64)
        yield _frame([rows(held, z, z, EDGE), rows(held, z, z, HELD)])


def _frame(out: list[list[np.ndarray]]) -> pd.DataFrame:
    seed, doc, at, other, other_at, kind = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"seed": seed, "doc": doc, "at": at.astype(np.int32), "other": other, "other_at": other_at.astype(np.int32), "kind": kind.astype(np.int8)})


def matched(found: DataFrame, *, neighbours: bool) -> DataFrame:
    """(seed, doc, at, other, other_at, kind): the occurrences of seeds that two documents have, with their homes, and with the two
    documents before if neighbours. found: a written table of (seed, doc, at)."""
    order = ("seed", "doc", "at")
    placed = found.repartitionByRange(partitions(found.sparkSession), *order).sortWithinPartitions(*order)
    rows = materialize(placed.mapInPandas(lambda batches: _matched(batches, neighbours), MATCH), "matches")
    edges = rows.filter(F.col("kind") == EDGE).groupBy("seed").agg(F.min(F.struct("doc", "at")).alias("home"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = edges.select(F.col("seed").alias("s"), "home")  # two for each partition at most
    real = F.col("kind").isin(HELD, MET)
    moved = rows.filter(F.col("kind") != EDGE).join(F.broadcast(edges), F.col("seed") == F.col("s"), "left")
    other, place = (F.when(real & F.col("home").isNotNull(), F.col(f"home.{a}")).otherwise(F.col(b)) for a, b in (("doc", "other"), ("at", "other_at")))
    return moved.select("seed", "doc", "at", other.alias("other"), place.alias("other_at"), "kind")


class Fenwick:
    """Largest (value, item) among the places up to a bound."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: float, item: int) -> None:
        i = place + 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, item)
            i += i & -i

    def top(self, place: int) -> tuple[float, int]:
        i, out = place + 1, (float("-inf"), -1)
        while i:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def pieces(xs: np.ndarray, ys: np.ndarray, widths: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, n, sure) of matches merged along a diagonal, where at most WINDOW words lie between them: n + K - 1 words, of
    which the matches cover `sure`."""
    order = np.lexsort((xs, xs - ys))
    x, d, w = xs[order], (xs - ys)[order], widths[order]
    # Diagonals are laid out one after the other, so that one running maximum gives how far the matches so far reach.
    turn = np.append(False, d[1:] != d[:-1])
    base = np.cumsum(turn) * (int(x.max(initial=0)) + int(w.max(initial=0)) + WINDOW + 1)
    reach = np.maximum.accumulate(x + w + base)
    before = np.append(-(WINDOW + 1), reach[:-1])
    new = turn | (x + base - before > WINDOW)
    new[:1] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], x.size) - 1
    sure = np.cumsum(x + w + base - np.maximum(x + base, np.minimum(np.where(new, x + base, before), x + w + base)))
    sure = np.diff(np.append(0, sure[last]))
    return sorted(zip(x[first].tolist(), (x - d)[first].tolist(), (reach[last] - base[last] - x[first] - K + 1).tolist(), sure.tolist()))


def chains(xs: np.ndarray, ys: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Local chains of the pieces of K-word matches, the best first."""
    parts = pieces(xs, ys, np.full(xs.size, K))
    return [[parts[i][:3] for i in c] for c in chained(parts)]


def chained(parts: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Local chains of pieces that come one after the other in both texts, the best first; each piece is in one."""
    places = sorted({y + n for _, y, n, _ in parts})
    tree = Fenwick(len(places))
    score, before = [0.0] * len(parts), [-1] * len(parts)
    ends = sorted(range(len(parts)), key=lambda i: parts[i][0] + parts[i][2])
    done = 0
    for i, (x, y, n, _) in enumerate(parts):
        while done < len(ends) and parts[ends[done]][0] + parts[ends[done]][2] <= x:
            j = ends[done]
            px, py, pn, _ = parts[j]
            tree.put(bisect_left(places, py + pn), score[j] + GAP * (px + pn + py + pn), j)
            done += 1
        value, j = tree.top(bisect_left(places, y + 1) - 1)
        gain = value - GAP * (x + y)
        score[i], before[i] = (n + K - 1 + gain, j) if gain > 0 else (n + K - 1.0, -1)
    out, used = [], [False] * len(parts)
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain and parts[chain[0]][0] + parts[chain[0]][2] + K - 1 - parts[chain[-1]][0] >= CHAIN_WORDS:
            out.append(chain[::-1])
    return out


def _common(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, a row of the table being one integer's bits."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        if m := row & at.get(w, 0):
            row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, equal words) that a passage goes on along the starts of a and b."""
    n = min(a.size, b.size)
    best = (0, 0)
    step = 64
    for at in range(0, n, step):
        same = a[: at + step][:n] == b[: at + step][:n]
        worth = np.cumsum(np.where(same, EQUAL, OTHER))
        top = np.maximum.accumulate(np.maximum(worth, 0))
        stop = np.flatnonzero(top - worth >= DROP)
        size = int(stop[0]) if stop.size else same.size
        if size:
            k = int(worth[:size].argmax())
            best = (k + 1, int(same[: k + 1].sum())) if worth[k] > 0 else (0, 0)
        if stop.size:
            break
        step *= 2
    return best


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """(start, end, home start, home end, equal words) of a chain between two texts' word hashes."""
    x, y, n = chain[0]
    left, equal = _extend(a[:x][::-1], b[:y][::-1])
    start, home = x - left, y - left
    ex, ey = x, y
    for x, y, n in chain:
        if x > ex or y > ey:
            gap_a, gap_b = a[ex:x], b[ey:y]
            if len(gap_a) and len(gap_b):
                equal += _common(gap_a.tolist(), gap_b.tolist())
        skip = max(0, ex - x, ey - y)
        size = n + K - 1
        equal += int((a[x + skip : x + size] == b[y + skip : y + size]).sum())
        ex, ey = max(ex, x + size), max(ey, y + size)
    right, more = _extend(a[ex:], b[ey:])
    return start, ex + right, home, ey + right, equal + more


def _passes(start: int, end: int, home: int, home_end: int, equal: int) -> bool:
    return min(end - start, home_end - home) >= MIN_WORDS and equal >= IDENTITY * max(end - start, home_end - home)


def _split(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The passages among the runs of a chain's successive pieces that don't share pieces and hold most equal words."""
    n = len(chain)
    part, link = [], np.zeros(n, np.int64)
    ex = ey = 0
    for k, (x, y, size) in enumerate(chain):
        end, home_end = x + size + K - 1, y + size + K - 1
        next_x, next_y, _ = chain[k + 1] if k + 1 < n else (a.size, b.size, 0)
        left, more = _extend(a[ex:x][::-1], b[ey:y][::-1])
        right, after = _extend(a[end:next_x], b[home_end:next_y])
        same = a[x - left : end] == b[y - left : home_end]
        if k:
            skip = max(0, ex - (x - left), ey - (y - left))
            link[k] = _common(a[ex : x - left].tolist(), b[ey : y - left].tolist()) - int(same[:skip].sum())
        part.append((x - left, y - left, end + right, home_end + right, int(same.sum()) + after))
        ex, ey = end + right, home_end + right
    sx, sy, ends, home_ends, equal = np.array(part, np.int64).T
    total = np.cumsum(equal + link)
    before = total - equal
    best, first = np.zeros(n + 1), [-1] * n
    for j in range(n):
        span, home_span, held = ends[j] - sx[: j + 1], home_ends[j] - sy[: j + 1], total[j] - before[: j + 1]
        ok = (np.minimum(span, home_span) >= MIN_WORDS) & (held >= IDENTITY * np.maximum(span, home_span))
        worth = np.where(ok, best[: j + 1] + held - 1e-6 * span, -1.0)  # of equal ones the shorter
        i = int(worth.argmax())
        best[j + 1] = best[j]
        if worth[i] > best[j]:
            best[j + 1], first[j] = worth[i], i
    out, j = [], n - 1
    while j >= 0:
        if (i := first[j]) >= 0:
            out.append((int(sx[i]), int(ends[j]), int(sy[i]), int(home_ends[j]), int(total[j] - before[i])))
            j = i
        j -= 1
    return out[::-1]


def aligned(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The chain as one passage or, if it isn't one as a whole, those that its parts are."""
    whole = align(a, b, chain)
    if _passes(*whole):
        return [whole]
    return _split(a, b, chain) if len(chain) > 1 else []


def _chain_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chains of each document with each other one, from matches sorted by document; a text's own matches at most are held."""
    held = None

    def rows(m: np.ndarray) -> pd.DataFrame:
        out: dict[tuple[int, int], list[int]] = {}
        for x in np.split(m, np.flatnonzero(np.diff(m[:, 0])) + 1):
            for other, c in chosen(np.unique(x[:, 1:], axis=0)):
                # Every chain after its number of pieces.
                out.setdefault((int(x[0, 0]), other), []).extend([len(c), *(v for piece in c for v in piece)])
        return pd.DataFrame([(doc, other, np.array(c, np.int32)) for (doc, other), c in out.items()], columns=["doc", "home", "chains"])

    for b in batches:
        m = np.stack([b[c].to_numpy(np.int64) for c in ("doc", "other", "at", "other_at", "width")], 1)
        m = m if held is None else np.concatenate([held, m])
        if not len(m):
            continue
        last = int(np.searchsorted(m[:, 0], m[-1, 0]))
        held = m[last:]
        if last:
            yield rows(m[:last])
    if held is not None and len(held):
        yield rows(held)


def _chains_of(flat: np.ndarray) -> Iterator[list[list[int]]]:
    at = 0
    while at < len(flat):
        n = int(flat[at])
        yield np.asarray(flat[at + 1 : at + 1 + 3 * n]).reshape(-1, 3).tolist()
        at += 1 + 3 * n


def chosen(matches: np.ndarray) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(other, chain) from a document's matches (other, at, other_at, width): chains within one that is a passage by its matches
    alone, with as many words or more, are left out."""
    matches = matches[np.argsort(matches[:, 0], kind="stable")]
    found = []
    for m in np.split(matches, np.flatnonzero(np.diff(matches[:, 0])) + 1):
        parts = pieces(m[:, 1], m[:, 2], m[:, 3])
        for c in chained(parts):
            (x, y, _, _), (ex, ey, n, _) = parts[c[0]], parts[c[-1]]
            found.append((-sum(parts[i][3] for i in c), int(m[0, 0]), x, ex + n + K - 1, ey + n + K - 1 - y, [parts[i][:3] for i in c]))
    found.sort(key=lambda f: f[:3])
    covered = np.zeros(max((f[3] for f in found), default=0), bool)
    out = []
    for sure, other, start, end, home_span, chain in found:
        if covered[start:end].all():
            continue
        out.append((other, chain))
        if min(end - start, home_span) >= MIN_WORDS and -sure >= IDENTITY * max(end - start, home_span):
            covered[start:end] = True
    return out


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            own, other = np.frombuffer(r.words, np.uint32), np.frombuffer(r.home_words, np.uint32)
            for chain in _chains_of(r.chains):
                for s, e, hs, he, equal in aligned(own, other, chain):
                    out.append((r.doc, s, e, r.home, hs, he, equal, round(equal / max(e - s, he - hs), 6)))
        yield pd.DataFrame(out, columns=["doc_id", "start_word", "end_word", "home_id", "home_start", "home_end", "n_equal", "identity"])


def passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, home_id, home_start, home_end, n_equal, identity): each fuzzy passage of a document
    that an earlier one, its home, has too, in places of words, ends exclusive."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    found = materialize(own.mapInPandas(_seed_rows, "seed long, doc long, at int"), "seeds")
    short = matched(found, neighbours=True)
    discard(found)
    # A text's own seeds at most: how long it is bounds these groups.
    near = short.filter(F.col("kind").isin(HELD, MET)).groupBy("doc").agg(F.collect_set("at").alias("places"))
    near = materialize(near.filter(F.array_max("places") - F.array_min("places") >= CHAIN_WORDS - K), "shared")
    texts = own.join(near.select(F.col("doc").alias("d")), F.col("doc_id") == F.col("d"), "left_semi")
    words = materialize(texts.mapInPandas(_word_rows, "doc_id long, words binary"), "words")
    found = words.join(near, F.col("doc_id") == F.col("doc")).select("doc_id", "words", "places")
    found = materialize(found.mapInPandas(_run_rows, "seed long, doc long, at int"), "runs")
    long = matched(found, neighbours=False)
    discard(found)
    both = [m.filter("doc <> other").select("doc", "other", "at", "other_at", F.lit(w).alias("width")) for m, w in ((short, K), (long, RUN))]
    by_doc = both[0].unionByName(both[1]).repartition(partitions(docs.sparkSession), "doc").sortWithinPartitions("doc")
    # Narrow rows, written: a hot home's documents lie in many partitions, and the joins may split them.
    chains_ = materialize(by_doc.mapInPandas(_chain_rows, "doc long, home long, chains array<int>"), "chains")
    held = materialize(chains_.select(F.explode(F.array("doc", "home")).alias("d")).distinct(), "held")
    words = words.join(held, F.col("doc_id") == F.col("d"), "left_semi")  # by a broadcast of the ids while these are few
    left = words.select(F.col("doc_id").alias("x"), "words")
    right = words.select(F.col("doc_id").alias("y"), F.col("words").alias("home_words"))
    pairs = chains_.join(left, F.col("doc") == F.col("x")).join(right, F.col("home") == F.col("y")).select("doc", "home", "chains", "words", "home_words")
    every = pairs.mapInPandas(_aligned, "doc_id long, start_word int, end_word int, home_id long, home_start int, home_end int, n_equal int, identity double")
    # Of passages within another one of the document only that one; a window holds one document's passages.
    order = Window.partitionBy("doc_id").orderBy("start_word", F.desc("end_word"), F.desc("n_equal"), "home_id", "home_start")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return every.withColumn("reach", reach).filter("reach is null or reach < end_word").drop("reach")
