"""Language identification of words by a linear-chain conditional random field.

A word's potentials come from its affixes (n-grams that touch a word boundary), inner n-grams and the word itself as a
lexicon entry, all hashed into one weight table; transitions between the languages of neighbouring words are learned with
them. Training sequences are spliced from runs of words of documents in different languages, as documents only carry one
language each and switching has to be seen to be learned. Words are labelled by forward-backward over whole texts, and a
document's language is the one with the largest share of its words with letters.

Forward-backward runs over blocks of BLOCK words at once: block transfer matrices first, then the messages between the
blocks of a text, then the words inside the blocks. The result is that of the plain recursion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from loomgraph.llm.common import PIECE_BYTES, claim, mapped, pieces, small

#: Training documents of one language, at most; the number of languages has no bound.
MAX_DOCS_PER_LANG = 600
#: Up to so many languages caches and batches have their full size; with more they shrink.
FULL_LANGS = 64
#: Training words of one document, at most, in runs spread over the whole of it; MAX_DOCS_PER_LANG documents then give a
#: language this many words at most, whatever the number of languages.
MAX_WORDS_PER_DOC = 120
#: Hash buckets of the weight table.
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4, 5)
BLOCK = 64
_CACHE_WORDS = 150_000
UNDETERMINED = "und"


def word_features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all words, one after the other, and where each word's begin. Words with no letter have only the bias
    feature 0."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" if any(map(str.isalpha, w)) else b"" for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = size[owner] - (np.arange(len(buf)) - start[owner]) if len(buf) else np.empty(0, np.int64)
    ids, owners = [np.zeros(len(words), np.int64)], [np.arange(len(words))]
    h = np.zeros(len(buf), np.uint64)
    for n in ORDERS:
        if len(buf) < n:
            break
        h = h[: len(buf) - n + 1] * np.uint64(0x100000001B3) + buf[n - 1 :] + np.uint64(1)
        ok = left[: len(h)] >= n
        x = h[ok] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        ids.append(((x >> np.uint64(24)) % np.uint64(buckets - 1)).astype(np.int64) + 1)
        owners.append(owner[: len(h)][ok])
    if len(buf):  # the whole word
        p = (buf + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ** (np.arange(len(buf), dtype=np.uint64) - start[owner].astype(np.uint64))
        has = np.flatnonzero(size)
        whole = np.add.reduceat(p, start[has])
        ids.append(((whole * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(22)) % np.uint64(buckets - 1)).astype(np.int64) + 1)
        owners.append(has)
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.searchsorted(owners[order], np.arange(len(words)))


def forward_backward(potentials: np.ndarray, trans: np.ndarray, lengths: np.ndarray, block: int = BLOCK, moves: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Marginals of every word of texts that follow each other in `potentials` (words x labels, log scale); trans holds
    log transition scores. A text's chain starts from all labels alike, by a transition from a word before it that is not
    seen. With `moves` also the expected number of transitions between every two labels, these first ones included."""
    n, k = potentials.shape
    if not n:
        return (np.zeros((0, k)), np.zeros((k, k))) if moves else np.zeros((0, k))
    t = np.exp(trans - trans.max())
    e = np.exp(np.maximum(potentials - potentials.max(1, keepdims=True), -25.0))
    lengths = np.asarray(lengths, np.int64)
    starts = np.cumsum(lengths) - lengths
    doc_order = np.argsort(-lengths, kind="stable")
    doc_order = doc_order[lengths[doc_order] > 0]
    nseg = -(-lengths[doc_order] // block)
    first = np.cumsum(nseg) - nseg
    total = int(nseg.sum())
    seg_doc = np.repeat(np.arange(len(doc_order)), nseg)
    seg_k = np.arange(total) - first[seg_doc]
    seg_at = starts[doc_order][seg_doc] + seg_k * block
    seg_len = np.minimum(block, lengths[doc_order][seg_doc] - seg_k * block)
    by_len = np.argsort(-seg_len, kind="stable")
    at, size = seg_at[by_len], seg_len[by_len]
    live = [int(np.searchsorted(-size, -j, "left")) for j in range(block)]  # segments longer than j
    m = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for j in range(int(size[0])):
        c = live[j]
        x = (m[:c].reshape(c * k, k) @ t).reshape(c, k, k)
        x *= e[at[:c] + j][:, None, :]
        if j % 8 == 7:
            x /= x.max((1, 2), keepdims=True)
        m[:c] = x
    m /= m.max((1, 2), keepdims=True)
    back = np.empty(total, np.int64)
    back[by_len] = np.arange(total)
    a_in, b_out = np.empty((total, k)), np.empty((total, k))
    a = np.full((len(doc_order), k), 1.0 / k)
    for j in range(int(nseg[0])):
        c = int(np.searchsorted(-nseg, -j, "left"))
        s = back[first[:c] + j]
        a_in[s] = a[:c]
        x = np.einsum("dk,dkl->dl", a[:c], m[s])
        a[:c] = x / x.sum(1, keepdims=True)
    b = np.full((len(doc_order), k), 1.0 / k)
    for j in range(int(nseg[0]) - 1, -1, -1):
        c = int(np.searchsorted(-nseg, -j, "left"))
        s = back[first[:c] + j]
        b_out[s] = b[:c]
        x = np.einsum("dkl,dl->dk", m[s], b[:c])
        b[:c] = x / x.sum(1, keepdims=True)
    out = np.empty((n, k))
    expected, before = np.zeros((k, k)), []
    # a_in and b_out are by segment; the words inside go longest segment first
    a = a_in
    for j in range(int(size[0])):
        c = live[j]
        if moves:
            before.append(a[:c] / a[:c].sum(1, keepdims=True))
        x = a[:c] @ t
        x *= e[at[:c] + j]
        if j % 8 == 7:
            x /= x.sum(1, keepdims=True)
        a[:c] = x
        out[at[:c] + j] = x
    b = b_out
    for j in range(int(size[0]) - 1, -1, -1):
        c = live[j]
        w = at[:c] + j
        out[w] *= b[:c]
        y = b[:c] * e[w]
        if moves:  # message from the left, transition, and all that the right says: the marginal of both words
            x = before[j]
            y = y / np.maximum(((x @ t) * y).sum(1, keepdims=True), 1e-300)
            expected += t * (x.T @ y)
            y = b[:c] * e[w]
        x = y @ t.T
        if j % 8 == 7:
            x /= x.sum(1, keepdims=True)
        b[:c] = x
    out /= out @ np.ones((k, 1))
    return (out, expected) if moves else out


class _Ids(dict):
    """Word -> row; a word met for the first time gets the next row and waits in `new`."""

    new: list[str] = []

    def __missing__(self, w: str) -> int:
        if not len(self):
            self.new = []
        i = self[w] = len(self)
        self.new.append(w)
        return i


class Field:
    """The trained field: languages, feature weights, transitions; remembers the potentials of words it has met."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray):
        self.langs, self.weights, self.trans = langs, weights.astype(np.float32), trans
        self._forget()

    def __reduce__(self):
        return _field, (tuple(self.langs), self.weights.tobytes(), self.trans.tobytes())

    def _forget(self):
        self._ids = _Ids()
        self._rows = np.zeros((1024, len(self.langs)), np.float32)
        self._letters = np.zeros(1024, bool)

    def potentials(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Potentials of the words, and which have letters."""
        if len(self._ids) > _CACHE_WORDS * FULL_LANGS // max(FULL_LANGS, len(self.langs)):
            self._forget()
        known = self._ids
        low = len(known)
        i = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        need = len(known)
        if need > low:
            if need > len(self._rows):
                grow = max(need, 2 * len(self._rows))
                self._rows = np.vstack([self._rows, np.zeros((grow - len(self._rows), len(self.langs)), np.float32)])
                self._letters = np.concatenate([self._letters, np.zeros(grow - len(self._letters), bool)])
            ids, at = word_features(known.new, len(self.weights))
            self._rows[low:need] = np.add.reduceat(self.weights[ids], at, axis=0)
            self._letters[low:need] = np.diff(np.append(at, len(ids))) > 1
            known.new = []
        return self._rows[i], self._letters[i]

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(t) for t in texts], np.int64)
        p, letters = self.potentials([w for t in texts for w in t])
        return forward_backward(p.astype(np.float64), self.trans, lengths), letters, lengths

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """For each text the expected share of each language among its words with letters; zeros where there is none."""
        g, letters, lengths = self.marginals(texts)
        g = g * letters[:, None]
        sums = np.vstack([np.zeros((1, g.shape[1])), np.cumsum(g, 0)])
        counts = np.concatenate([[0], np.cumsum(letters)])
        end = np.cumsum(lengths)
        tot, cnt = sums[end] - sums[end - lengths], counts[end] - counts[end - lengths]
        return np.where(cnt[:, None] > 0, tot / np.maximum(cnt, 1)[:, None], 0.0)


@lru_cache(1)
def _field(langs: tuple[str, ...], weights: bytes, trans: bytes) -> Field:
    k = len(langs)
    return Field(list(langs), np.frombuffer(weights, np.float32).reshape(-1, k), np.frombuffer(trans, np.float64).reshape(k, k))


def excerpt(words: list[str], seed: int, most: int = MAX_WORDS_PER_DOC) -> list[list[str]]:
    """Runs of words, of geometric length, together at most `most` and spread over the whole list; all of a short list."""
    rng = np.random.default_rng(seed)
    runs, left = [], min(most, len(words))
    sizes = []
    while left > 0:
        sizes.append(min(left, int(rng.geometric(1 / 20))))
        left -= sizes[-1]
    gap = (len(words) - sum(sizes)) / max(1, len(sizes))  # each run lies somewhere in its own share of the rest
    at = used = 0
    for i, size in enumerate(sizes):
        at = used + int((i + rng.random()) * gap)
        runs.append(words[at : at + size])
        used += size
    return runs


def seen_moves(y: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The transitions of the true labels. What a text's first word comes from is not seen: it counts by its posterior."""
    k = len(trans)
    seen = np.zeros((k, k))
    first = np.zeros(len(y), bool)
    first[(np.cumsum(lengths) - lengths)[np.asarray(lengths) > 0]] = True
    i = np.flatnonzero(~first)
    np.add.at(seen, (y[i - 1], y[i]), 1)
    t = np.exp(trans - trans.max())
    return seen + t / t.sum(0) * np.bincount(y[first], minlength=k)


def train(rows: list[tuple[list[list[str]], str]], epochs: int = 6, rate: float = 0.3, seed: int = 7) -> Field | None:
    """Conditional likelihood by adaptive gradient steps on spliced sequences, from rows of (runs of words, language); None
    without rows."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    runs: list[tuple[int, list[str]]] = [(number[lang], r) for rs, lang in rows for r in rs if r]
    rng.shuffle(runs)
    seqs: list[list[tuple[int, list[str]]]] = []
    while runs:
        size = int(rng.integers(1, 5))
        seqs.append(runs[:size])
        runs = runs[size:]
    k = len(langs)
    w, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    gw, gt = np.full((BUCKETS, k), 1e-4), np.full((k, k), 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for at in range(0, len(order), 64):
            part = [seqs[i] for i in order[at : at + 64]]
            words = [x for s in part for _, r in s for x in r]
            if not words:
                continue
            y = np.array([i for s in part for i, r in s for _ in r])
            lengths = np.array([sum(len(r) for _, r in s) for s in part], np.int64)
            ids, starts = word_features(words)
            p = np.add.reduceat(w[ids], starts, axis=0)
            g, expected = forward_backward(p, trans, lengths, moves=True)
            d = g.copy()
            d[np.arange(len(y)), y] -= 1
            d /= 64
            size = np.diff(np.append(starts, len(ids)))
            each = np.repeat(d, size, axis=0)
            hit, where = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(where, each[:, j], len(hit)) for j in range(k)], 1)
            gw[hit] += grad**2
            w[hit] -= rate * grad / np.sqrt(gw[hit])
            grad_t = (expected - seen_moves(y, lengths, trans)) / 64
            gt += grad_t**2
            trans = trans - rate * grad_t / np.sqrt(gt)
    return Field(langs, w, trans)


def sample_rows(docs: DataFrame, per_lang: int = MAX_DOCS_PER_LANG) -> list[tuple[list[list[str]], str]]:
    """(runs of words, lang) of about per_lang documents of each language at most, chosen by a hash; rows equal in id and
    text count as one. Only the runs, MAX_WORDS_PER_DOC words a document, leave the executors. Documents without text or
    language, or labelled `und`, are left out."""
    d = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNDETERMINED))
    share = F.greatest(F.lit(1), F.floor(F.least(F.lit(1.0), F.lit(per_lang) / F.col("count")) * 1_000_000)).alias("share")
    counts = d.groupBy("lang").count().select("lang", share)
    n = counts.count()
    if not n:
        return []
    h = F.xxhash64("doc_id", "text")
    got = d.join(small(counts, n), "lang").filter(F.pmod(h, F.lit(1_000_000)) < F.col("share")).select(F.col("lang").cast("string").alias("lang"), h.alias("h"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds = b.column(1).to_pylist()
            cut = [[" ".join(r) for r in excerpt(t.lower().split(), s & 0xFFFFFFFF)] for t, s in zip(b.column(2).to_pylist(), seeds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.list_(pa.string()))], ["lang", "h", "runs"])

    rows = mapped(got, run, "lang string, h long, runs array<string>").groupBy("lang", "h").agg(F.first("runs").alias("runs"))
    return [([x.split() for x in r["runs"]], r["lang"]) for r in sorted(rows.toLocalIterator(), key=lambda r: (r["lang"], r["h"]))]


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs with lang_pred (string), score (double, the expected share of its words in that language) and n_switches (long,
    changes of language between neighbouring words with letters); own columns of these names are replaced. A null text,
    or one without letters, is `und` with score 0, as every text is if nothing was learned. Equal shares go to the
    language that comes first by code point; repeated rows get the same; an empty table gives none."""
    own = ["lang_pred", "score", "n_switches"]
    docs = docs.drop(*own)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        claim("langid", field._forget if field else lambda: None)
        wide = (len(field.langs) if field else 1) / FULL_LANGS
        for whole in batches:
            for b in pieces(whole, at, int(PIECE_BYTES / max(1, wide**2))):
                texts = [t.lower().split() if t else [] for t in b.column(at).cast(pa.string()).to_pylist()]
                pred, score, moves = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                if field is not None:
                    g, letters, lengths = field.marginals(texts)
                    best = g.argmax(1)
                    own_doc = np.repeat(np.arange(len(texts)), lengths)[letters]
                    lab, gl = best[letters], g[letters]
                    cnt = np.bincount(own_doc, minlength=len(texts))
                    tot = np.stack([np.bincount(own_doc, gl[:, j], len(texts)) for j in range(g.shape[1])], 1)
                    change = (lab[1:] != lab[:-1]) & (own_doc[1:] == own_doc[:-1])
                    moves = np.bincount(own_doc[1:][change], minlength=len(texts)).astype(np.int64)
                    top = tot.argmax(1)
                    score = np.where(cnt > 0, tot[np.arange(len(texts)), top] / np.maximum(cnt, 1), 0.0)
                    pred = [field.langs[j] if c else UNDETERMINED for j, c in zip(top, cnt)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(moves)], [*b.schema.names, *own])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("n_switches", LongType())])
    return mapped(docs, run, schema)


def held_out() -> F.Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, per_lang: int = MAX_DOCS_PER_LANG) -> DataFrame:
    """identify() with a field trained on the documents with a language that are not held out (null ids aren't). Documents
    labelled `und` teach nothing and `und` is no learned language. Columns other than doc_id, text and lang pass through."""
    rows = sample_rows(docs.filter(~held_out()), per_lang)
    return identify(docs, train(rows))
