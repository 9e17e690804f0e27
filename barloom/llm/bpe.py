"""BPE encoding by tree concatenation, and decoding.

Most texts split at once into short pretokens; their ids are looked up in a bounded table that the tokenizers library
fills, for many texts together once for each different pretoken. Long texts are cut in Spark into pieces that are encoded in parallel tasks. Then the pieces of a text are joined
pairwise as a tree: around each join a window of text is encoded afresh and grows until it agrees with the left piece at
one position and with the right piece at another one; at worst it is both pieces whole, so that the result is always what
one encoding of the whole text gives.

Agreement at a position: either both encodings start a pretoken there, or both lie within one unsplit run of characters
and have the same token there. The pattern that makes pretokens looks behind at nothing, so that from a shared start on
both see the same; and a sequence of BPE tokens of a pretoken is right if every adjacent pair of tokens is, which a shared
token carries from one encoding to the other. The last two pretokens of a piece may depend on what follows, and are never
agreed on.

Cases: null and empty texts give no ids; special tokens' strings in a text become the special tokens, as the library has
it; ids that a text's end leaves incomplete decode to replacement characters, also as the library has it.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise
from sys import byteorder

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AT_ONCE

#: Characters of a piece; texts of up to twice as many are encoded at once.
PIECE = 16_384
#: First window on either side of a join, in characters.
MARGIN = 64
#: Bytes of the texts that are split together, about; a longer text is alone.
TOGETHER = 4 << 20
#: Pretokens whose ids a worker remembers, and as many older ones; FEWER where batches of texts lie beside them.
REMEMBERED, FEWER = 500_000, 100_000

# The letters of the fast pattern, and the contractions of the vocabulary's own pattern.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
FAST = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Texts with other characters than these are left to the library whole.
ODD = re.compile(rf"[^\t-\r -~{LETTERS}]")

# The same pattern by bytes: what each byte of UTF-8 is (0: odd), where C3 leads all letters beyond ASCII.
LETTER, DIGIT, OTHER, BLANK, WHITE = range(1, 6)
KIND = np.zeros(256, np.uint8)
KIND[33:127], KIND[48:58], KIND[9:14], KIND[32] = OTHER, DIGIT, WHITE, BLANK
KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = LETTER
KIND[[0x97, 0xB7]] = 0  # multiplication and division sign, after C3
SHORTENED = re.compile(rb"'(?:[stmd]|re|ve|ll)")


def _bounds(texts: pa.StringArray) -> np.ndarray:
    """Where each text starts in the array's bytes, and the end."""
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)


def _data(texts: pa.StringArray) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts, and where each starts in them, and the end."""
    bounds, data = _bounds(texts), texts.buffers()[2]
    first, last = int(bounds[0]), int(bounds[-1])
    return data.slice(first, last - first).to_pybytes() if last > first else b"", bounds - bounds[0]


def odd_bytes(data: np.ndarray) -> np.ndarray:
    """Places of bytes that ODD's characters have, one at least of each."""
    odd = KIND[data] == 0
    if data.size and data.max() >= 0x80:
        after = (data & 0xC0) == 0x80
        odd[0] |= after[0]
        odd[1:] |= after[1:] != (data[:-1] == 0xC3)  # bytes that follow another lead than C3
    return np.flatnonzero(odd)


def split(data: bytes, first: np.ndarray) -> np.ndarray:
    """Where the matches of FAST start in texts without odd characters that stand one after another. first: where the texts start."""
    kind = KIND[np.frombuffer(data, np.uint8)]
    text = np.zeros(kind.size, bool)
    text[first] = True
    white = kind >= BLANK
    start = text.copy()
    # What isn't white takes a blank before it along; of a run of white space, what stands last before it is apart.
    start[1:] |= np.where(white[1:], ~white[:-1], (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK))
    start[:-1] |= white[:-1] & ~white[1:] & ~text[1:]
    a, b = np.array([m.span() for m in SHORTENED.finditer(data)], np.int64).reshape(-1, 2).T
    own = start[a] & ~text[a + 1] & ~text[b - 1]  # of two or three characters, in one text
    start[a[own] + 1] = False
    start[b[own & (b < kind.size)]] = True
    return np.flatnonzero(start)


class Tokenizer(dict):
    """The library's tokenizer with a table of pretoken -> ids as little-endian 32-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import tokenizers

        self.remembered = remembered
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.reach = max(map(len, self.specials), default=0)
        self.model = self.library.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self._shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self._points = np.array([0, *(ord(self._shown[b]) for b in range(1, 256))], "<u4")  # 0 stands between pretokens
        self._bytes: list[bytes] | None = None
        self._older: dict[str, bytes] = {}

    def _make_room(self, n: int) -> None:
        if len(self) + n > self.remembered:  # what is met again is taken over from the older half
            self._older = dict(self)
            self.clear()

    def __missing__(self, pretoken: str) -> bytes:
        self._make_room(1)
        found = self[pretoken] = self._older.get(pretoken) or self.pretoken(pretoken)
        return found

    def forget(self) -> None:
        """Empty the table: a worker that waits for other tasks holds no more than the library's tokenizer."""
        self.clear()
        self._older = {}
        pa.default_memory_pool().release_unused()

    def pretoken(self, text: str) -> bytes:
        """Ids of one pretoken by the library's model alone, which takes bytes as printable characters."""
        if text[0] == " " and text.isascii() and text[1:].isalnum():
            shown = self._shown[32] + text[1:]
        else:
            shown = text.encode("utf-8").decode("latin-1").translate(self._shown)
        ids = array("I", [x.id for x in self.model.tokenize(shown)])
        if byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def pretokens(self, different: list[str]) -> list[bytes]:
        """Ids of each of many different pretokens without odd characters."""
        found = list(map(self.get, different))
        missing = [x for x, ids in zip(different, found) if ids is None]
        if not missing:
            return found
        self._make_room(len(missing))
        self.update((x, self._older[x]) for x in missing if x in self._older)
        if new := [x for x in missing if x not in self]:
            shown = self._points[np.frombuffer("\0".join(new).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\0")
            tokenize, ids, ends = self.model.tokenize, array("I"), [0]
            for x in shown:
                ids.extend([y.id for y in tokenize(x)])
                ends.append(4 * len(ids))
            if byteorder == "big":
                ids.byteswap()
            data = ids.tobytes()
            self.update((x, data[a:b]) for x, (a, b) in zip(new, pairwise(ends)))
        return [self[x] if ids is None else ids for x, ids in zip(different, found)]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if ODD.search(text) or any(s in text for s in self.specials):
            return self.whole(text)
        return b"".join(map(self.__getitem__, FAST.findall(text)))

    def encode_all(self, texts: pa.StringArray) -> Iterator[bytes]:
        """What encode() gives for each of many texts, none of them null."""
        bounds, at = _bounds(texts).astype(np.int64), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TOGETHER, "right")) - 1)
            yield from self._together(texts.slice(at, to - at))
            at = to

    def _together(self, texts: pa.StringArray) -> Iterator[bytes]:
        data, bounds = _data(texts)
        odd = odd_bytes(np.frombuffer(data, np.uint8)).tolist()
        if self.special:  # ends as well: what lies across two texts may hide one in the second
            odd += [k for m in re.finditer(self.special.pattern.encode(), data) for k in (m.start(), m.end() - 1)]
        apart = set((np.searchsorted(bounds, odd, "right") - 1).tolist())
        if not apart:
            yield from self._plain(data, bounds)
            return
        others = self._plain(*_data(texts.filter(pa.array([k not in apart for k in range(len(texts))]))))
        for k in range(len(texts)):
            yield self.whole(texts[k].as_py()) if k in apart else next(others)

    def _plain(self, data: bytes, bounds: np.ndarray) -> Iterator[bytes]:
        """Ids of texts without odd characters and special tokens."""
        start = split(data, bounds[:-1][bounds[:-1] < bounds[1:]])
        each = pa.StringArray.from_buffers(start.size, pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        different = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self.pretokens(different), pa.large_binary()).take(each.indices)
        ends, ids = np.frombuffer(ids.buffers()[1], np.int64), memoryview(ids.buffers()[2] or b"")
        for a, b in pairwise(ends[np.searchsorted(start, bounds)].tolist()):
            yield bytes(ids[a:b])

    def decode(self, ids: bytes) -> str:
        if self._bytes is None:
            self._bytes = self._token_bytes()
        table = self._bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")

    def _token_bytes(self) -> list[bytes]:
        """The bytes of each id: byte-level vocabularies write byte b as a printable character."""
        byte_of = {c: b for b, c in self._shown.items()}
        out = [b""] * self.library.get_vocab_size()
        added = self.library.get_added_tokens_decoder()
        for token, i in self.library.get_vocab().items():
            out[i] = token.encode() if i in added else bytes(byte_of[c] for c in token)
        return out

    # Tree concatenation

    def piece(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, start of each token in characters) of a text on its own."""
        e = self.library.encode(text, add_special_tokens=False)
        return np.array(e.ids, "<u4"), np.array([a for a, _ in e.offsets], np.int64)

    def starts(self, text: str) -> list[int]:
        """Where pieces of the pattern start, which runs between special tokens, and special tokens themselves."""
        out, at = [], 0
        for a, b in [*self.special_spans(text), (len(text), len(text))]:
            out += [at + p for _, (p, _) in self.library.pre_tokenizer.pre_tokenize_str(text[at:a])]
            if b > a:
                out.append(a)
            at = b
        return out

    def special_spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the special tokens in a text."""
        return [m.span() for m in self.special.finditer(text)] if self.special else []

    def outside(self, text: str, at: int) -> tuple[int, int]:
        """Start and end of the special token that a position lies inside of, or the position twice."""
        first = max(0, at - self.reach)
        for a, b in self.special_spans(text[first : at + self.reach]):
            if first + a < at < first + b:
                return first + a, first + b
        return at, at

    def join(self, text: str, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and starts of text from those of text[:cut] and text[cut:], each encoded on its own."""
        n, margin = len(text), MARGIN
        while True:
            lo, hi = cut - margin, cut + margin
            if lo <= 0 and hi >= n:
                return self.piece(text)
            lo, hi = max(0, lo), min(n, hi)
            # No special token is cut at the window's ends.
            lo, hi = self.outside(text, lo)[0], self.outside(text, hi)[1]
            lo = int(left[1][np.searchsorted(left[1], lo, "right") - 1]) if lo else 0
            window = self.piece(text[lo:hi])
            a = self._agree_left(text, left, window, lo, cut, hi)
            b = self._agree_right(text, right, window, lo, cut, hi, n)
            if a is not None and b is not None and a <= b:
                i, j = np.searchsorted(window[1] + lo, a), np.searchsorted(window[1] + lo, b)
                k, m = np.searchsorted(left[1], a), np.searchsorted(right[1] + cut, b)
                parts = [(left[0][:k], left[1][:k]), (window[0][i:j], window[1][i:j] + lo), (right[0][m:], right[1][m:] + cut)]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            margin *= 4

    def _agree_left(self, text, left, window, lo, cut, hi) -> int | None:
        """A position before the cut from which the window may take over from the left piece."""
        if lo == 0:
            return 0
        own = [p + lo for p in self.starts(text[lo:cut])]  # from a token's start in the left piece
        if self.unsplit(text[lo:cut]):
            return self._shared_token(left, (window[0], window[1] + lo), lo, cut)
        seen = {p + lo for p in self.starts(text[lo:hi])}
        # own[1:] are starts in the left piece as well: its scan and this one meet at the end of the run that holds lo.
        for p in own[1:-2]:
            if p in seen:
                return p
        return None

    def _agree_right(self, text, right, window, lo, cut, hi, n) -> int | None:
        """A position from the cut on from which the right piece may take over from the window."""
        if hi == n and lo == 0:
            return n
        if self.unsplit(text[lo:hi]):
            return self._shared_token((window[0], window[1] + lo), (right[0], right[1] + cut), cut, hi)
        seen = [p + lo for p in self.starts(text[lo:hi])]
        seen = set(seen if hi == n else seen[:-2])
        for p in [p + cut for p in self.starts(text[cut:hi])][1:]:
            if p in seen and p < hi:
                return p
        return n if hi == n else None

    @staticmethod
    def unsplit(text: str) -> bool:
        """Whether a text is one run of letters, or of digits, with no place where the pattern might split it."""
        return text.isascii() and (text.isalpha() or text.isdigit())

    @staticmethod
    def _shared_token(a, b, lo: int, hi: int) -> int | None:
        """Start of a token that both have, away from the ends of the stretch where they may differ."""
        both = np.intersect1d(a[1], b[1])
        ends_a, ends_b = np.append(a[1][1:], hi), np.append(b[1][1:], hi)
        for p in both[(both > lo + 8) & (both < hi - 8)].tolist():
            i, j = np.searchsorted(a[1], p), np.searchsorted(b[1], p)
            if a[0][i] == b[0][j] and ends_a[i] == ends_b[j] < hi - 8:
                return p
        return None

    def tree(self, pieces: list[str], encoded: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Ids of the pieces' whole text: neighbours are joined until one is left."""
        level = list(zip(pieces, encoded))
        while len(level) > 1:
            up = []
            for k in range(0, len(level) - 1, 2):
                (t, x), (u, y) = level[k], level[k + 1]
                up.append((t + u, self.join(t + u, x, y, len(t))))
            level = up + level[len(level) - len(level) % 2 :]
        return level[0][1][0] if level else np.array([], "<u4")


@lru_cache(maxsize=2)
def tokenizer(path: str, remembered: int = REMEMBERED) -> Tokenizer:
    """One for each worker process, kept between its tasks, but for its table where a task forgets it."""
    return Tokenizer(path, remembered)


def _digests(t: Tokenizer, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.decode(ids).encode("utf-8", "replace")).hexdigest()


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text", piece: int = PIECE, digest: bool = False) -> DataFrame:
    """(doc_id, ids binary) for every row, ids as little-endian unsigned 32-bit integers; digest: (doc_id, n_tokens,
    ids_sha256, decoded_sha256) instead, so that ids of all texts needn't be carried further."""
    kind = docs.schema[id_col].dataType.simpleString()
    # Ids go through Python as strings: pandas would make numbers with nulls floating point.
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id string, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids binary")

    names = [c.split()[0] for c in schema.split(", ")]

    def rows(t: Tokenizer, ids: Iterable, encoded: Iterable[bytes]) -> pd.DataFrame:
        if not digest:
            return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "ids": pd.Series(list(encoded), dtype=object)})
        found = [_digests(t, x) for x in encoded]
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "n_tokens": [x[0] for x in found], "ids_sha256": [x[1] for x in found], "decoded_sha256": [x[2] for x in found]})

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, FEWER)
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):  # of a batch of texts only so many are Python's strings at once
                ids, text = b.slice(i, AT_ONCE).columns
                encoded = [t.encode(x) for x in text.to_pylist()]
                columns = [pa.array(encoded, pa.binary())]
                if digest:
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*(_digests(t, x) for x in encoded)), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=names)
        t.forget()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path, FEWER)
        for b in batches:
            found = [t.piece(x) for x in b["text"]]
            yield b.assign(ids=[x[0].tobytes() for x in found], starts=[x[1].astype("<i4").tobytes() for x in found])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        t = tokenizer(path, FEWER)
        group = group.sort_values("part")
        encoded = [(np.frombuffer(a, "<u4"), np.frombuffer(b, "<i4").astype(np.int64)) for a, b in zip(group["ids"], group["starts"])]
        return rows(t, [group["doc_id"].iloc[0]], [t.tree(list(group["text"]), encoded).tobytes()])

    long = F.length("text") > 2 * piece
    at_once = own.filter(~long).mapInArrow(short, schema)
    cut = own.filter(long).withColumn("row", F.monotonically_increasing_id())
    cut = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int"))))
    cut = cut.select("doc_id", "row", "part", F.expr(f"substring(text, part * {piece} + 1, {piece})").alias("text"))
    done = cut.mapInPandas(pieces, "doc_id string, row long, part int, text string, ids binary, starts binary")
    every = at_once.unionByName(done.groupBy("row").applyInPandas(joined, schema))
    return every.withColumn("doc_id", F.col("doc_id").cast(kind))
