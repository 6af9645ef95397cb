"""SentencePiece encoding and decoding as shortest paths of a weighted finite-state transducer.

The model file is compiled into a transducer: the normaliser (character map, space escape, dummy prefix), whose longest
match makes it deterministic, one arc a piece, and for each character without a piece a fallback arc that writes the
pieces of its bytes. Composed with an input it is a lattice over the positions of that input, and the encoding is the
lattice's shortest path in the tropical semiring.

* Unigram models: an arc weighs the negated score of its piece, a fallback arc the cost of an unknown character.
* BPE models: merging has no such weights, but a segmentation is the one that merging gives exactly if each piece encodes
  to itself and each neighbouring pair encodes to that pair. So the states carry the last piece, an arc after a state
  weighs 0 if the pair is admissible and infinity if not, and the one path of finite weight is the encoding. It is found
  depth first, longest arcs first: as a prefix has only one encoding, a position that led nowhere never need be met again.

Words are composed apart where no piece spans the seam, and paths of words already met are remembered."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import claim, mapped, pieces

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words whose paths a worker remembers, their characters and pieces, and pairs of pieces; each is emptied when full.
_CACHE_WORDS, _CACHE_SIZE, _CACHE_PAIRS = 250_000, 6_000_000, 300_000


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        v = s = 0
        while True:
            b = buf[i]
            v |= (b & 127) << s
            i, s = i + 1, s + 7
            if b < 128:
                return v, i

    i = 0
    while i < len(buf):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            v, i = buf[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            v, i = buf[i : i + n], i + n
        yield key >> 3, v


class CharMap:
    """A precompiled character map: a double-array trie of source strings and their replacements; longest match wins."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.out = blob[4 + size :]

    def __call__(self, text: str) -> str:
        raw, units, done, i = text.encode(), self.units, bytearray(), 0
        while i < len(raw):
            node, best = 0, None
            at = (units[0] >> 10) << ((units[0] & 512) >> 6)
            j = i
            while j < len(raw):
                node = at ^ raw[j]
                u = units[node] if node < len(units) else 0
                if (u & 0x800000FF) != raw[j]:
                    break
                j += 1
                at = node ^ ((u >> 10) << ((u & 512) >> 6))
                if u >> 8 & 1:
                    best = (j, units[at] & 0x7FFFFFFF)
            if best:
                i, k = best
                done += self.out[k : self.out.index(b"\0", k)]
            else:
                n = 1 if raw[i] < 128 else 2 if raw[i] < 224 else 3 if raw[i] < 240 else 4
                done += raw[i : i + n]
                i += n
        return done.decode("utf-8", "replace")


class _Words(dict):
    """Word -> number; a word met for the first time gets the next one and waits in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        i = self[w] = len(self)
        self.new.append(w)
        return i


class _Fallback(dict):
    """Character -> the pieces that its fallback arc writes, made of the byte pieces when it is first met."""

    def __init__(self, bytes_: dict[int, int], unknown: int):
        super().__init__()
        self.bytes, self.unknown = bytes_, unknown

    def __missing__(self, c: str) -> tuple[int, ...]:
        p = tuple(self.bytes[b] for b in c.encode("utf-8", "replace")) if self.bytes else (self.unknown,)
        if len(self) < 100_000:
            self[c] = p
        return p


class Transducer:
    """The compiled model. encode() gives piece ids, decode() the text they stand for."""

    def __init__(self, model: bytes):
        self.model = model
        self._compile()

    def _compile(self) -> None:
        pieces: list[tuple[str, float, int]] = []
        kind, norm = UNIGRAM, {}
        for f, v in _fields(self.model):
            if f == 1:
                p = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(v))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0], p[3]))
            elif f == 2:
                kind = dict(_fields(v)).get(3, UNIGRAM)
            elif f == 3:
                norm = dict(_fields(v))
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} is neither unigram nor BPE")
        self.bpe = kind == BPE
        self.charmap = CharMap(norm[2]) if norm.get(2) else None
        self.prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.score = [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.is_byte = frozenset(self.bytes.values())
        self.unk = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.text = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        # arcs out of a position: a trie of nodes [children by character, piece id or -1]
        self.arcs: dict[str, list] = {}
        for p, i in () if self.bpe else self.ids.items():
            at = self.arcs
            for c in p:
                node = at.setdefault(c, [{}, -1])
                at = node[0]
            node[1] = i
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.unknown_cost = -min((s for _, s, t in pieces if t == NORMAL), default=0.0) + 10.0
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        seams = not inner and not any(t == USER for _, _, t in pieces)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else "")).findall if seams else lambda s: [s] if s else []
        if self.bpe:  # the arcs of pieces that encode to themselves, and how far arcs reach that begin alike
            self.whole = {p: i for p, i in self.ids.items() if self._merge(p) == [p]}
            self.reach: dict[str, int] = {}
            for p in self.whole:
                for k in range(1, min(3, len(p)) + 1):
                    self.reach[p[:k]] = max(len(p), self.reach.get(p[:k], 0))
        # pairs of pieces that are known to be admissible, or not
        self._good: dict[int, set[int]] = {}
        self._bad: dict[int, set[int]] = {}
        self._pairs = 0
        self.fallback = _Fallback(self.bytes, self.unk)
        self._forget()

    def _forget(self) -> None:
        self._words, self._size, self._start = _Words(), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._flat, self._used, self._chars = np.zeros(4096, np.int32), 0, 0

    def normalise(self, text: str) -> str:
        if self.charmap:
            text = self.charmap(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def _merge(self, s: str) -> list[str]:
        """The segmentation that merging gives: best score first, leftmost among equals. For short strings."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _admits(self, a: int, b: int) -> bool:
        """Whether merging a's and b's text gives exactly a, b."""
        if b in self._bad.get(a, ()):
            return False
        x, y = self.pieces[a][0], self.pieces[b][0]
        ok = self._merge(x + y) == [x, y]
        if self._pairs > _CACHE_PAIRS:
            self._good.clear()
            self._bad.clear()
            self._pairs = 0
        (self._good if ok else self._bad).setdefault(a, set()).add(b)
        self._pairs += 1
        return ok

    def _search(self, s: str) -> tuple[int, ...]:
        """The path of finite weight through a BPE model's states (position, last piece) composed with s."""
        n, get, good, reach, admits = len(s), self.whole.get, self._good, self.reach.get, self._admits
        i, last, j = 0, -1, min(n, reach(s[:3], 2))  # a negative piece stands for a fallback arc
        taken: list[tuple[int, int]] = []  # where an arc begins, and its piece
        dead: set[int] = set()
        while i < n:
            after = good.get(last, ())
            while j > i:
                t = get(s[i:j])
                if t is not None and (last < 0 or t in after or admits(last, t)) and j not in dead:
                    break
                j -= 1
            if j == i:
                if s[i] in self.whole or i + 1 in dead:
                    if not taken:
                        raise ValueError("no path")  # cannot be: merging always gives one
                    dead.add(i)
                    j = i - 1
                    i = taken.pop()[0]
                    last = taken[-1][1] if taken else -1
                    continue
                t, j = -1, i + 1
            taken.append((i, t))
            last, i = t, j
            j += reach(s[i : i + 3], 2)
            if j > n:
                j = n
        return tuple([t for _, t in taken] if min([t for _, t in taken], default=0) >= 0 else [x for at, t in taken for x in ((t,) if t >= 0 else self.fallback[s[at]])])

    def path(self, s: str) -> tuple[int, ...]:
        """The shortest path of the transducer composed with s, a normalised string."""
        n, ids, arcs = len(s), self.ids, self.arcs
        if self.bpe:
            return self._search(s)
        cost = [0.0] + [float("inf")] * n
        arc: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        for i in range(n):
            c = cost[i]
            single = s[i] in ids
            at, j = arcs.get(s[i]), i + 1
            while at is not None:
                if at[1] >= 0:
                    w = c - self.score[at[1]]
                    if w < cost[j]:
                        cost[j], arc[j] = w, (i, at[1])
                if j == n:
                    break
                at = at[0].get(s[j])
                j += 1
            if not single and c + self.unknown_cost < cost[i + 1]:
                cost[i + 1], arc[i + 1] = c + self.unknown_cost, (i, -1)
        out: list[tuple[int, ...]] = []
        i = n
        while i:
            j, t = arc[i]
            out.append((t,) if t >= 0 else self.fallback[s[j:i]])
            i = j
        return tuple(x for p in reversed(out) for x in p)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """The piece ids of all texts one after the other, where each text's end, and whether they, decoded, are the
        normalised text."""
        if len(self._words) > _CACHE_WORDS or self._used + self._chars > _CACHE_SIZE:
            self._forget()
        known, words, counts, normal = self._words, [], [], []
        for x in texts:
            x = self.normalise(x)
            w = self.cut(x)
            words += w
            counts.append(len(w))
            normal.append(x)
        low = len(known)
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.new:
            self._learn(low, known.new)
            known.new = []
        size = self._size[at]
        ends = np.cumsum(size)
        flat = self._flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._start[at] - (ends - size), size)]
        ends = np.append(0, ends)[np.cumsum(counts, dtype=np.int64)] if texts else np.zeros(0, np.int64)
        exact, ids, a = [], flat.tolist(), 0
        for x, b in zip(normal, ends.tolist()):
            exact.append(self.decode(ids[a:b]) == self._plain(x.replace(SPACE, " ")))
            a = b
        return flat, ends, exact

    def _learn(self, low: int, new: list[str]) -> None:
        """Remembers the paths of new words, which are numbered from `low`."""
        paths = [self.path(w) for w in new]
        size = np.array([len(p) for p in paths], np.int64)
        ids = np.fromiter((i for p in paths for i in p), np.int32, int(size.sum()))
        high, used = low + len(new), self._used + len(ids)
        if high > len(self._size):
            grow = max(high, 2 * len(self._size))
            self._size, self._start = (np.append(x, np.zeros(grow - len(x), np.int64)) for x in (self._size, self._start))
        if used > len(self._flat):
            self._flat = np.append(self._flat, np.zeros(max(used, 2 * len(self._flat)) - len(self._flat), np.int32))
        self._size[low:high], self._start[low:high] = size, self._used + np.cumsum(size) - size
        self._flat[self._used : used] = ids
        self._used, self._chars = used, self._chars + sum(map(len, new))

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self._plain(b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace"))

    def _plain(self, s: str) -> str:
        """s without the dummy prefix."""
        return s[1:] if self.prefix and s[:1] == " " else s


@lru_cache(1)
def _compiled(model: bytes) -> Transducer:
    return Transducer(model)


@dataclass(frozen=True)
class Model:
    """A model file's bytes; compiled once in each process that uses it."""

    data: bytes

    def transducer(self) -> Transducer:
        return _compiled(self.data)


def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model: Model, with_ids: bool = True) -> DataFrame:
    """doc_id of docs with ids (array of int), n_tokens, n_bytes (tokens of byte fallback), digest (of the ids), and exact
    (whether the document's ids, decoded, are the normalised text). A null text has null ids and exact, and no tokens; an empty one has
    no tokens. Repeated rows are encoded each; other columns are not read."""
    t = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = t.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("spm", _compiled.cache_clear)
        transducer = model.transducer()
        in_bytes = np.zeros(len(transducer.pieces), np.int64)
        in_bytes[list(transducer.is_byte)] = 1
        for whole in batches:
            for b in pieces(whole, 1):
                texts = b.column(1).to_pylist()
                flat, ends, same = transducer.encode_batch([x or "" for x in texts])
                ends = np.append(0, ends)
                sums = np.concatenate([[0], np.cumsum(in_bytes[flat])])
                exact = pa.array([None if x is None else e for x, e in zip(texts, same)], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=exact.is_null() if exact.null_count else None)
                yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(sums[ends[1:]] - sums[ends[:-1]]), exact], ["doc_id", "ids", "n_bytes", "exact"])

    out = mapped(t, run, f"doc_id {kind}, ids array<int>, n_bytes long, exact boolean")
    own = [F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "n_bytes", F.xxhash64("ids").alias("digest"), "exact"]
    return out.select("doc_id", *(["ids"] if with_ids else []), *own)


def decode(tokens: DataFrame, model: Model) -> DataFrame:
    """tokens(doc_id, ids) as (doc_id, text); null ids are null text, and so are ids that are no pieces: lists with a null,
    a negative number or one beyond the vocabulary. Repeated rows are decoded each; other columns are not read."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("spm", _compiled.cache_clear)
        transducer = model.transducer()
        n = len(transducer.pieces)

        def text(ids: list[int | None] | None) -> str | None:
            return None if ids is None or any(i is None or not 0 <= i < n for i in ids) else transducer.decode(ids)

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(text, b.column(1).to_pylist()), pa.string())], ["doc_id", "text"])

    return mapped(tokens.select("doc_id", F.col("ids").cast("array<long>").alias("ids")), run, f"doc_id {kind}, text string")
