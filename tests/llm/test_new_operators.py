"""Alignment of two tokenizers, hard negatives and byte shards against brute force, with nulls, blanks, long texts, ties,
repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import alignment, negatives, queries, sharding

from .test_operators import SCHEMA, prose, rows

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path(A), queries.tokenizer_path(B)


@pytest.fixture(scope="module")
def libraries(paths):
    import sentencepiece
    import tokenizers

    t = tokenizers.Tokenizer.from_file(paths[0])
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=paths[1])


TEXTS = [
    "a b", "The quick brown fox.", "", None, "  two  spaces ", "tab\tand\nline\n", "é日本 😀 naïve", "<|endoftext|> and <s> are text", "▁ is a mark", "x" * 3000, "\x00 odd \xa0", "1234567 8.9", "Ünïcödé " * 50,
    *(" ".join(w) for w in zip(*[iter("the cat sat on the mat and the dog ran to the house".split())] * 4)),
]


def token_bytes(libraries, text):
    """Ids and bytes by the libraries alone, or nothing."""
    t, sp = libraries
    if not text:
        return [], []
    shown = {}
    n = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            shown[chr(b)] = b
        else:
            shown[chr(256 + n)] = b
            n += 1
    a = [(i, bytes(shown[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in s) == want for s in (a, b)) else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def alignment_by_hand(libraries, texts):
    docs, pairs = [], Counter()
    for text in texts:
        a, b = map(spans, token_bytes(libraries, text))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        links = [(i, j) for i, _, e in a for j, _, f in b if e == f]
        pairs.update(links)
        lo, groups = 0, []
        for hi in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in x if lo <= s and e <= hi) for x in (a, b)))
            lo = hi
        docs.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (i, j), n in pairs.items():
        best[j] = max(best.get(j, 0), n)
    return [(n, m, g, len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), sha) for n, m, g, links, sha in docs]


def test_alignment_by_hand(spark, paths, libraries):
    rng = random.Random(3)
    texts = TEXTS + [prose(rng, 300) for _ in range(3)] + ["".join(rng.choice("ab é\n.9") for _ in range(200)) for _ in range(20)]
    texts += [texts[1], texts[-1]]
    table = spark.createDataFrame([(i if i % 9 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pair long").repartition(3)
    got = alignment.measure(table, *paths)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i if i % 9 else None, *x) for i, x in enumerate(alignment_by_hand(libraries, texts))]
    order = lambda x: (x[0] is None, str(x))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_alignment_in_small_blocks(spark, paths, libraries, monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, 40) for _ in range(30)]
    monkeypatch.setattr(alignment, "STRETCH", 100)
    writer = alignment.Text(50_257, 32_000)
    t = alignment.Bytewise(paths[0]), alignment.Pieces(paths[1])
    blocks = []
    for lo in range(0, 30, 7):
        block = alignment._Block()
        block.add(list(map(str, range(lo, min(lo + 7, 30)))), texts[lo : lo + 7], t, writer)
        blocks += block.rows
    assert [r[1:] for r in blocks] == [(x[0], x[1], x[2], x[3], x[6]) for x in alignment_by_hand(libraries, texts)]


def test_alignment_empty(spark, paths):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.measure(empty, *paths).isEmpty() and alignment.links(empty, *paths).isEmpty()


def test_links_of_each_kind(spark, paths, libraries):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for kind in alignment.KINDS:
        got = sorted((r.doc_id, r.a_place, r.b_place, r.a_id, r.b_id, r.shared) for r in alignment.links(table, *paths, kind).collect())
        want = []
        for k, text in enumerate(TEXTS):
            a, b = map(spans, token_bytes(libraries, text))
            ends = sorted({e for *_, e in a} & {e for *_, e in b})
            group = lambda e: sum(x < e for x in ends)  # noqa: E731, B023
            for x, (i, s, e) in enumerate(a):
                for y, (j, u, f) in enumerate(b):
                    shared = min(e, f) - max(s, u)
                    if kind == "group":
                        shared = int(group(e) == group(f))
                    if shared > 0 and (kind != "end" or e == f):
                        want.append((k, x, y, i, j, shared))
        assert got == sorted(want)
    with pytest.raises(ValueError):
        alignment.links(table, *paths, "other")


def test_products_of_sparse_matrices():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = (rng.integers(-2, 3, (rng.integers(1, 9), 7)) * (rng.random((1, 7)) < 0.6) for _ in range(2))
        a, b = (alignment.Csr(np.append(0, np.cumsum((m != 0).sum(1))), np.nonzero(m)[1], m[m != 0], 7) for m in (x, y))
        got = np.zeros((x.shape[0], y.shape[0]), int)
        i, j, n = a.times(b.transposed()).entries()
        got[i, j] = n
        assert (got == x @ y.T).all()


def test_long_texts_in_pieces(paths, monkeypatch):
    t = alignment.Bytewise(paths[0])
    text = "日本 <|endoftext|> and words, 12345 " * 200 + "y" * 2000
    want = t.whole(text)
    monkeypatch.setattr(alignment, "LONG", 1000)
    assert t.ids(text) == want


def negatives_by_hand(table):
    own = []
    for i, v, x in table:
        if x is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        own.append((i, x, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    own = list(dict.fromkeys(own))
    out = []
    for a in own:
        if a[0] is None or a[0] % 100:
            continue
        rest = [(-sum(p * q for p, q in zip(a[2], r[2])), r[0] is None, r[0] or 0, r) for r in own if r[0] != a[0]]
        rest.sort(key=lambda x: x[:3])
        for s, _, _, p in [x for x in rest if x[3][1] == a[1]][:5]:
            fit = [x for x in rest if x[3][1] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a[0], p[0], k + 1, x[3][0], -s, -x[0]) for k, x in enumerate(fit)]
    return out


VECTORS = "vec_id long, embedding array<float>, label int, score string"


def mined(table, **sizes):
    return negatives.hard_negatives(negatives.labelled(table), F.col("id") % 100 == 0, **sizes)


def test_hard_negatives_by_hand(spark):
    rng = random.Random(8)
    vec = lambda n=6: [rng.choice([-1, 0, 0.25, 0.5, 1, rng.gauss(0, 1)]) for _ in range(n)]
    data = [(i * 10, vec(), rng.randrange(3)) for i in range(120)]
    data += [(5, None, 1), (6, vec(), None), (7, [0.5, None, 1.0], 1), (8, [float("nan")] * 6, 1), (9, [float("inf")] * 6, 0), (None, vec(), 1), (11, vec(3), 2), (12, [], 0), (13, [1e9, -1e9, 1e9], 1), (2000, vec(3), 1), (2100, [0.0] * 6, 2), (2200, [1e7] * 6, 0), data[3], data[10]]
    data += [(3000 + i, [1.0, 0.5, 0, 0, 0, 0], i % 2) for i in range(40)]  # one vector, many ties
    data = [(i, v and [c if c is None else float(c) for c in v], x) for i, v, x in data]
    table = spark.createDataFrame([(*x, "clash") for x in data], VECTORS).repartition(5)
    want = sorted(negatives_by_hand(data), key=str)
    assert len(want) > 300
    for sizes in ({}, {"rows_in_group": 17, "anchors_in_block": 3}):
        assert sorted(map(tuple, mined(table, **sizes).collect()), key=str) == want


def test_hard_negatives_of_nothing(spark):
    assert mined(spark.createDataFrame([], VECTORS)).isEmpty()
    alone = spark.createDataFrame([(100, [1.0], 1, ""), (3, [1.0], 2, "")], VECTORS)
    assert mined(alone).isEmpty()


def test_ids_with_two_vectors(spark):
    """Either is an anchor, neither is the other's partner."""
    table = spark.createDataFrame([(100, [1.0, 0.0], 1, ""), (100, [0.0, 1.0], 1, ""), (1, [1.0, 1.0], 1, ""), (2, [0.5, 0.25], 2, "")], VECTORS)
    got = sorted(map(tuple, mined(table).collect()))
    assert got == [(100, 1, 1, 2, 65536, 128 * 256)]  # the other twin's product with 2 is 64 * 256, under 30 %


def test_products_are_exact():
    big = float(1 << 40)
    a, b = np.array([[big, 3.0]]), np.array([[big, 5.0], [-big, 1.0], [big * big, 0.0]])
    want = [max(-(1 << 63), min((1 << 63) - 1, int(x * u) if abs(x * u) > 2**62 else int(x) * int(u) + int(y) * int(v))) for (x, y) in a.tolist() for u, v in b.tolist()]
    assert negatives.products(a, b).tolist() == [want]


def test_shards_by_hand(spark):
    data = rows() + [(None, "no id", "en", "s", 5, "x", "y"), (None, None, "en", "s", 0, "x", "y")] + [(50, "same " * 20, "en", "s", 0, "x", "y")] * 30
    got = sharding.shard_table(spark.createDataFrame(data, SCHEMA).repartition(4), 7).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert len(got) == len(data)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    got.sort(key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    total, before, places = sum(r["size"] for r in got), 0, Counter()
    for r in got:
        assert r.shard == min(6, (2 * before + r["size"]) * 7 // (2 * total)) and r.slot == places[r.shard]
        places[r.shard] += 1
        before += r["size"]


def test_shards_are_balanced(spark):
    rng = random.Random(2)
    data = [(i, prose(rng, rng.randrange(1, 60)), "en", "s", 0, "x", "y") for i in range(1500)]
    by = Counter()
    for r in sharding.shard_table(spark.createDataFrame(data, SCHEMA).repartition(6)).collect():
        by[r.shard] += r["size"]
    share, most = sum(by.values()) / 24, max(len(t) + 8 for _, t, *_ in data)
    assert len(by) == 24 and all(abs(n - share) <= most for n in by.values())


def test_shards_empty_and_written(spark, tmp_path):
    assert sharding.shard_table(spark.createDataFrame([], SCHEMA)).isEmpty()
    table = spark.createDataFrame([*rows(), *rows()[:3]], SCHEMA)
    sharding.write(table, f"file://{tmp_path}/shards", 3)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t) for i, t, *_ in [*rows(), *rows()[:3]])
    spans = [(r.a, r.b) for r in back.filter("doc_id is not null").groupBy("shard").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("shard").collect()]
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
