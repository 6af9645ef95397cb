"""Language-model scoring with a weighted backoff automaton.

The model is an interpolated n-gram model of any order over words with one start and one end a text. With c(h) the count of
a history, c(hw) that of an n-gram, p(w) the smoothed unigram and K the weight of the shorter history for that length,

    p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K),    h' being h without its first word.

It is compiled into an automaton. Histories seen in training are its states, n-grams seen in training its arcs: from h over
w, with weight log10 p(w | h), to the longest history that hw ends with. Where a state has no arc for a word its failure
arc is taken, with weight log10 (K / (c(h) + K)), to h', and so on down to the empty history, which has an arc for every
word. A text is one traversal, left to right, that carries the state and adds up the weights. No history reaches over the
start of its text.

K is fitted for each length on all training texts, by leaving one out: if each n-gram is taken away once, as many turn out
new as there are n-grams seen once, and of those after h the model expects c(h) K / (c(h) - 1 + K).

The automaton of the whole corpus is as large as the corpus and is never in one place. Texts are cut into blocks of about
BLOCK_TOKENS tokens. Each block sends its distinct words and n-grams, with their counts in training texts, to buckets of
their hash; a bucket adds them up and answers each block with the totals, in the block's order. A block then compiles the
part of the automaton that its texts can reach, and traverses it. Words and n-grams are compared by 56-bit hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, claim, groups_of, hashed_words, mapped, mix, pieces, scratch, stored

#: Tokens of a block, about; entries a bucket shall hold, about, and in how many parts it adds them up.
BLOCK_TOKENS, BUCKET_ENTRIES, PARTS = 1_000_000, 3_000_000, 8
#: Counts that are told apart when K is fitted; what is seen more often counts as seen endlessly often.
HIST = 1024
#: K lies within these.
K_RANGE = (0.01, 1e6)
#: Tokens that a traversal takes at once from each of its places.
STRIDE = 64
BITS = np.uint64(8)
END, START = np.uint64(0x5BD1E995A1B2C3D4) >> BITS, np.uint64(0x1F83D9ABFB41BD6B) >> BITS


# --- coding: a number mostly takes a byte, a hash in a sorted list five


def shrunk(v: np.ndarray) -> bytes:
    v = v.astype(np.uint64)
    big = v >= 255
    return len(v).to_bytes(4, "little") + np.minimum(v, np.uint64(255)).astype(np.uint8).tobytes() + v[big].tobytes()


def grown(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    out = np.frombuffer(raw, np.uint8, n, 4).astype(np.uint64)
    out[out == 255] = np.frombuffer(raw, np.uint8, offset=4 + n).copy().view(np.uint64)
    return out


def packed(keys: np.ndarray, base: int) -> bytes:
    """Sorted keys, none below base, as differences: low bytes as they are, the rest shrunk."""
    d = np.diff(keys, prepend=np.uint64(base))
    mean = int(keys[-1] - np.uint64(base)) / len(keys) if len(keys) else 0
    low = max(0, math.ceil((math.log2(max(mean, 1)) - 6) / 8))
    return bytes([low]) + shrunk(d >> np.uint64(8 * low)) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes()


def unpacked(raw: bytes, base: int) -> np.ndarray:
    low, n = raw[0], int.from_bytes(raw[1:5], "little")
    high = raw[1 : len(raw) - low * n]
    d = np.zeros((n, 8), np.uint8)
    if low:
        d[:, :low] = np.frombuffer(raw, np.uint8, offset=len(raw) - low * n).reshape(n, low)
    return np.cumsum(d.view("<u8").ravel() + (grown(high) << np.uint64(8 * low)), dtype=np.uint64) + np.uint64(base)


def squeezed(v: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte and compressed."""
    planes = np.ascontiguousarray(v.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(v).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expanded(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw[4:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


# --- blocks


def gram_keys(words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 2 to order words: the tokens that end an n-gram of so many, and its hash. A text's first token follows the
    start, and no n-gram begins before it."""
    h = words[tokens]
    start = np.cumsum(lengths) - lengths
    place = np.arange(len(h)) - np.repeat(start, lengths)
    last = h
    for n in range(2, order + 1):
        before = np.empty_like(h)
        before[1:] = last[:-1]
        before[start] = START
        last = mix(mix(before + np.uint64(0x9E3779B97F4A7C15)) ^ h) >> BITS
        ends = np.flatnonzero(place >= n - 2)
        yield ends, last[ends]


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("lm")
        block = TaskContext.get().partitionId() << 32
        ids, held, toks, sizes, n = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            words, tokens, count = np.unique(np.concatenate(toks), return_inverse=True, return_counts=True)
            often = np.argsort(-count, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            cols = [np.array(held, np.uint8).tobytes(), np.concatenate(sizes).astype(np.int32).tobytes(), squeezed(rank[tokens]), squeezed(often), packed(words, 0)]
            flat = pa.concat_arrays(ids)
            one = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(tokens)]), pa.array([len(words)]), one, *(pa.array([c], pa.binary()) for c in cols)], ["block", "n", "v", *_BLOCK])

        for whole in batches:
            for b in pieces(whole, 1):
                words, counts = hashed_words(as_bytes(b.column(1)))
                at = np.cumsum(counts)
                toks.append(np.insert(words >> BITS, at, END))
                sizes.append(counts + 1)
                held += b.column(2).to_pylist()
                ids.append(b.column(0))
                n += len(toks[-1])
                if n >= size:
                    yield flush()
                    block, ids, held, toks, sizes, n = block + 1, [], [], [], [], 0
        if toks:
            yield flush()

    return run


_BLOCK = ("ids", "held", "lengths", "tokens", "often", "words")


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (sorted), tokens (places among them), lengths of the texts, which are held out."""
    return unpacked(row["words"], 0), expanded(row["often"])[expanded(row["tokens"])], np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(row["held"], np.uint8).astype(bool)


def _base(bucket: int, buckets: int) -> int:
    """The smallest hash of a bucket."""
    return -(-(bucket << 56) // buckets)


def _entries(buckets: int, order: int):
    bases = [_base(i, buckets) for i in range(buckets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                words, tokens, lengths, held = _read(row)
                train = ~np.repeat(held, lengths)
                sent = [(words, np.bincount(tokens[train], minlength=len(words)))]
                for ends, keys in gram_keys(words, tokens, lengths, order):
                    keys, at = np.unique(keys, return_inverse=True)
                    sent.append((keys, np.bincount(at[train[ends]], minlength=len(keys))))
                cuts = [[*np.searchsorted(keys, np.array(bases, np.uint64)).tolist(), len(keys)] for keys, _ in sent]
                some = [k for k in range(buckets) if any(c[k + 1] > c[k] for c in cuts)]
                for low in range(0, len(some), 64):
                    part = some[low : low + 64]
                    lists = [[[f(x, k, c) for x, c in zip(sent, cuts)] for k in part] for f in (lambda x, k, c: packed(x[0][c[k] : c[k + 1]], bases[k]), lambda x, k, c: shrunk(x[1][c[k] : c[k + 1]]))]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([row["block"]] * len(part), pa.int64()), *(pa.array(x, pa.list_(pa.binary())) for x in lists)], ["bucket", "block", "keys", "counts"])

    return run


def totals(keys: list[np.ndarray], counts: list[np.ndarray], low: int, high: int, parts: int = PARTS) -> tuple[list[np.ndarray], np.ndarray, int]:
    """For each sender the totals of its sorted keys, which lie from low to high; of the distinct keys how many have each
    total (HIST - 1 for that or more), and the sum of all totals."""
    out = [np.empty(len(k), np.uint64) for k in keys]
    hist, train = np.zeros(HIST, np.int64), 0
    edges = [low + (high - low) * i // parts for i in range(parts)]
    at = [[*np.searchsorted(k, np.array(edges, np.uint64)).tolist(), len(k)] for k in keys]
    for i in range(parts):
        own = [(s, a[i], a[i + 1]) for s, a in enumerate(at) if a[i + 1] > a[i]]
        if not own:
            continue
        distinct, where = np.unique(np.concatenate([keys[s][a:b] for s, a, b in own]), return_inverse=True)
        total = np.bincount(where, np.concatenate([counts[s][a:b] for s, a, b in own]).astype(np.float64), len(distinct)).astype(np.uint64)
        hist += np.bincount(np.minimum(total, np.uint64(HIST - 1)).astype(np.int64), minlength=HIST)
        train += int(total.sum())
        p = 0
        for s, a, b in own:
            out[s][a:b] = total[where[p : p + b - a]]
            p += b - a
    return out, hist, train


def _answers(buckets: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        for g in groups_of(batches, ["bucket"]):
            bucket = g.column("bucket")[0].as_py()
            low, high = _base(bucket, buckets), _base(bucket + 1, buckets)
            keys, counts = g.column("keys").to_pylist(), g.column("counts").to_pylist()
            got, hists, train = [], [], 0
            for m in range(order):
                t, hist, n = totals([unpacked(k[m], low) for k in keys], [grown(c[m]) for c in counts], low, high)
                got.append([shrunk(x) for x in t])
                hists.append(hist)
                train = train if m else n
            blocks = g.column("block").to_pylist()
            first = [np.concatenate(hists).tolist(), *[None] * (len(blocks) - 1)]
            for i in range(0, len(blocks), 256):
                n = len(blocks[i : i + 256])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks[i : i + 256], pa.int64()), pa.array([bucket] * n, pa.int32()), pa.array([[x[s] for x in got] for s in range(i, i + n)], pa.list_(pa.binary())), pa.array([0 if i or s else train for s in range(n)], pa.int64()), pa.array(first[i : i + 256], pa.list_(pa.int64()))],
                    ["block", "bucket", "totals", "train", "hist"])

    return run


def fitted(shorter: np.ndarray, once: int) -> float:
    """K for n-grams of which `once` are seen once, their histories being seen shorter[c] times c times."""
    c = np.arange(1, HIST)
    n = np.asarray(shorter, np.float64)[1:]
    lo, hi = K_RANGE
    for _ in range(100):
        k = math.sqrt(lo * hi)
        new = np.where(c < HIST - 1, c * k / (c - 1 + k), k) @ n
        lo, hi = (k, hi) if new < once else (lo, k)
    return math.sqrt(lo * hi)


# --- automaton


@dataclass
class Automaton:
    """The part of the automaton that a block's texts can reach. By order (from one word up) and by number of the n-gram:
    whether it is an arc, the arc's weight, and the weight of the failure arc of the state that the n-gram is as a history
    (order by order up to one less than the longest; before these, that of the start)."""

    arcs: list[np.ndarray]
    weights: list[np.ndarray]
    fails: list[np.ndarray]
    start_fail: float

    @property
    def order(self) -> int:
        return len(self.arcs)


def compiled(counts: list[np.ndarray], numbers: list[np.ndarray], start: np.ndarray, texts: int, total: int, known: int, prior: Sequence[float]) -> Automaton:
    """counts: by order and number of the n-gram, in training. numbers: by order, the number of the n-gram that ends at each
    token, or -1. start: the texts' first tokens. prior: K by length of the history, from one word up."""
    first = np.zeros(len(numbers[0]), bool)
    first[start] = True
    p = [(counts[0] + 0.1) / (total + 0.1 * (known + 1))]
    fails = []
    for m in range(1, len(counts)):
        own = numbers[m]
        ends = np.flatnonzero(own >= 0)
        place = np.empty(len(counts[m]), np.int64)
        place[own[ends]] = ends  # a token that ends it
        below = counts[m - 1][numbers[m - 1][place - 1]] if len(place) else np.zeros(0)
        history = np.where(first[place], texts, below) if m == 1 else below
        k = prior[m - 1]
        p.append((counts[m] + k * p[m - 1][numbers[m - 1][place]]) / (history + k))
        fails.append(np.log10(k / (counts[m - 1] + k)))
    return Automaton([c > 0 for c in counts], [np.log10(x) for x in p], fails, math.log10(prior[0] / (texts + prior[0])) if len(counts) > 1 else 0.0)


def traverse(a: Automaton, numbers: list[np.ndarray], start: np.ndarray, lengths: np.ndarray, texts: int, stride: int = STRIDE) -> np.ndarray:
    """The weight that each token adds on the traversal of its text. Texts are taken up at many places at once; a place that
    is not a text's beginning starts from the empty history, as many words earlier as a history has at most, so that it
    carries the state of the one traversal when it comes to its own tokens."""
    n = len(numbers[0])
    out = np.zeros(n)
    warm = a.order - 1
    per = -(-lengths // stride)
    text = np.repeat(np.arange(len(lengths)), per)
    own = start[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * stride
    stop = np.minimum(own + stride, (start + lengths)[text])
    at = np.maximum(own - warm, start[text])
    # the state is the number of words of its history; the history itself is the n-gram before the token
    state = np.where((at == start[text]) & (warm > 0) & (texts > 0), 1, 0)
    begins = np.zeros(n + 1, bool)
    begins[start] = True
    live = np.arange(len(text))
    while len(live):
        i, s = at[live], state[live]
        cost = np.zeros(len(i))
        m = s.copy()  # words of the history whose arc is tried
        for h in range(a.order - 1, 0, -1):
            fail = np.flatnonzero(m == h)
            g = numbers[h][i[fail]]
            fail = fail[~((g >= 0) & a.arcs[h][g])]
            if len(fail):
                j = i[fail]
                state_fail = a.fails[h - 1][numbers[h - 1][j - 1]]
                cost[fail] += np.where(begins[j], a.start_fail, state_fail) if h == 1 else state_fail
                m[fail] = h - 1
        w = np.empty(len(i))
        for h in range(a.order):
            hit = np.flatnonzero(m == h)
            w[hit] = a.weights[h][numbers[h][i[hit]]]
        mine = i >= own[live]
        out[i[mine]] = (cost + w)[mine]
        seen = (m > 0) | a.arcs[0][numbers[0][i]]
        state[live] = np.where(seen, np.minimum(m + 1, warm), 0)
        at[live] += 1
        live = live[at[live] < stop[live]]
    return out


def _scores(total: int, known: int, texts: int, prior: Sequence[float], order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        for g in groups_of(batches, ["block"]):
            head = int(np.flatnonzero(g.column("bucket").to_numpy() < 0)[0])
            row = {n: g.column(n)[head].as_py() for n in _BLOCK[1:]}
            words, tokens, lengths, held = _read(row)
            at_bucket = np.argsort(g.column("bucket").to_numpy(), kind="stable")[1:]
            got = g.column("totals")
            got = [got[int(i)].as_py() for i in at_bucket]
            counts = [np.concatenate([grown(x[m]) for x in got]).astype(np.float64) for m in range(order)]
            numbers = [tokens]
            for ends, keys in gram_keys(words, tokens, lengths, order):
                own = np.full(len(tokens), -1, np.int64)
                own[ends] = np.unique(keys, return_inverse=True)[1]
                numbers.append(own)
            start = np.cumsum(lengths) - lengths
            a = compiled(counts, numbers, start, texts, total, known, prior)
            score = traverse(a, numbers, start, lengths, texts)
            ids = pa.concat_arrays(g.column("ids").slice(head, 1).chunks).flatten()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held), pa.array(lengths), pa.array(np.add.reduceat(a.arcs[0][tokens], start, dtype=np.int64)), pa.array(np.add.reduceat(a.weights[0][tokens], start)), pa.array(np.add.reduceat(score, start))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def lm_scores(docs: DataFrame, held: F.Column | None = None, prior: Sequence[float] | None = None, block_tokens: int = BLOCK_TOKENS, order: int = 3) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens and n_known (tokens seen in training), train_tokens, base_score
    (log10 of the smoothed unigram probability) and score (log10 of the model's, whose longest n-grams have `order` words).
    Training texts are those not held out; the default holds out ids whose crc32 as text is a multiple of 10, and never a
    null id. A null text is an empty one: one token, its end. Without training texts every token has the probability of an
    unknown one. `prior` has K by length of the history, from one word up; by default it is fitted. Repeated rows count and
    are scored each; columns other than doc_id and text are not read; an empty table gives none."""
    if order < 1:
        raise ValueError(f"order {order} is below 1")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0 if held is None else held
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    kind = d.schema["doc_id"].dataType.simpleString()
    with scratch() as made:
        blocks = stored(mapped(d, _blocks(block_tokens), f"block long, n long, v long, ids array<{kind}>, held binary, lengths binary, tokens binary, often binary, words binary"), "lm", compression="zstd")
        n_blocks, tokens, words = (x or 0 for x in blocks.agg(F.count("*"), F.sum("n"), F.sum("v")).first())
        buckets = max(4, -(-((order - 1) * tokens + words) // BUCKET_ENTRIES))
        sent = mapped(blocks.select("block", *_BLOCK[1:]), _entries(buckets, order), "bucket int, block long, keys array<binary>, counts array<binary>")
        answers = sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
        answers = stored(mapped(answers, _answers(buckets, order), "block long, bucket int, totals array<binary>, train long, hist array<long>"), "lmsum", compression="zstd")
        total = answers.agg(F.sum("train")).first()[0] or 0
        hist = np.zeros((order, HIST))
        for r in answers.filter("hist IS NOT NULL").select(F.posexplode("hist")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # order * HIST rows
            hist[r["pos"] // HIST, r["pos"] % HIST] = r["n"]
        known = int(hist[0, 1:].sum())
        fit = [fitted(hist[m - 1], int(hist[m, 1])) for m in range(1, order)]
        texts = d.filter(~F.col("held")).count()
        rows = blocks.select("block", F.lit(-1).alias("bucket"), *_BLOCK).unionByName(answers.select("block", "bucket", "totals"), allowMissingColumns=True)
        rows = rows.repartition(max(n_blocks, 1), "block").sortWithinPartitions("block", "bucket")
        out = mapped(rows, _scores(total, known, texts, fit if prior is None else prior, order), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        made.clear()  # the result reads them
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
