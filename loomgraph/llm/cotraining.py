"""A quality classifier by co-training.

Two views of a document: its content (frequencies of hashed byte pairs, repetition, marks, the layout of its lines), which
is read off the text alone, and its page metadata (source, language, recorded length), for which the text is not read.
One linear classifier a view starts from the labelled documents; in each round either names the unlabelled documents that
it is surest of, and the other one learns from them. Both are then calibrated on labelled documents kept out of training.
As the views share nothing but the class, their calibrated log-odds add up, less the log-odds of the class that both
contain: that is the score."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, claim, mapped, pieces
from loomgraph.llm.linear import calibrate, fit_logistic, predict
from loomgraph.llm.toxicity import labelled_sample

#: Labelled and unlabelled documents that the models are fitted on, at most.
MAX_LABELLED, MAX_UNLABELLED = 8_000, 8_000
ROUNDS = 4
#: Pseudo-labels that a view gives in a round: this share of the pool, split by class as the labels are, at this confidence.
SHARE, CONFIDENCE = 0.05, 0.9
#: Hash buckets of byte pairs, sources and languages; lengths fall into classes by powers of two.
PAIR_BITS, SOURCE_BUCKETS, LANG_BUCKETS, LENGTHS = 8, 128, 64, 24
PAIRS, SHAPES = 1 << PAIR_BITS, 11
MARKS, CAPITALS = b"#*$%&|<>!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def content(text: bytes | None) -> np.ndarray:
    """The content view of a whole text; zeros for an empty one."""
    out = np.zeros(PAIRS + SHAPES)
    if not text:
        return out
    b = np.frombuffer(text, np.uint8)
    if len(b) > 1:
        pair = (b[:-1].astype(np.uint32) * 251 + b[1:]) * np.uint32(2654435761) >> np.uint32(32 - PAIR_BITS)
        out[:PAIRS] = np.sqrt(np.bincount(pair, minlength=PAIRS) / (len(b) - 1))
    words = text.split()
    n, size = len(words), len(text)
    lines = [x for x in text.split(b"\n") if x]
    m = max(1, len(lines))
    stops = sum(x.endswith((b".", b"!", b"?", b":")) for x in lines)
    marks, upper = (size - len(text.translate(None, x)) for x in (MARKS, CAPITALS))
    out[PAIRS : PAIRS + 6] = np.log1p(len(lines)), np.log1p(size / m), stops / m, 1 - len(set(lines)) / m, min(1.0, 5 * marks / size), upper / size
    if n:
        out[PAIRS + 6 :] = np.log1p(n), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, np.log1p(size / n), 1.0
    return out


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view: fields of the page, each with a place for null."""
    out = np.zeros(SOURCE_BUCKETS + LANG_BUCKETS + LENGTHS)
    out[0 if source is None else 1 + xxhash.xxh3_64_intdigest(source) % (SOURCE_BUCKETS - 1)] = 1
    out[SOURCE_BUCKETS + (0 if lang is None else 1 + xxhash.xxh3_64_intdigest(lang) % (LANG_BUCKETS - 1))] = 1
    out[SOURCE_BUCKETS + LANG_BUCKETS + (0 if n_chars is None or n_chars < 0 else 1 + min(LENGTHS - 2, int(n_chars).bit_length()))] = 1
    return out


def held_out(y: np.ndarray, seed: int) -> np.ndarray:
    """Every fifth row of each class, for calibration only."""
    out = np.zeros(len(y), bool)
    rng = np.random.default_rng(seed)
    for c in (0, 1):
        at = rng.permutation(np.flatnonzero(y == c))
        out[at[4::5]] = True
    return out


@dataclass
class Scaled:
    """A linear model on standardised features, with its calibration."""

    mean: np.ndarray
    std: np.ndarray
    w: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return predict(self.w, (x - self.mean) / self.std)

    def logit(self, x: np.ndarray) -> np.ndarray:
        p = np.clip(self.raw(x), 1e-6, 1 - 1e-6)
        return self.a * np.log(p / (1 - p)) + self.b


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], seed: int = 11) -> tuple[Scaled, Scaled]:
    """Trains both views from labelled rows and a pool. A view's calibration sees only rows that are held out; a class with
    fewer than five rows has none, and the models stay as trained."""
    held = held_out(y, seed)
    mean, std = [], []
    for v, u in zip(views, pool):
        n = max(1, len(v) + len(u))
        mean.append((v.sum(0, dtype=np.float64) + u.sum(0, dtype=np.float64)) / n)
        std.append(np.maximum(np.sqrt((((v - mean[-1]) ** 2).sum(0) + ((u - mean[-1]) ** 2).sum(0)) / n), 1e-3))
    z = [((v - m) / s).astype(np.float32) for v, m, s in zip(views, mean, std)]
    zp = [((v - m) / s).astype(np.float32) for v, m, s in zip(pool, mean, std)]
    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels that each view has got from the other
    prior = y[~held].mean() if (~held).any() else 0.5

    def fitted(i: int) -> np.ndarray:
        at = np.fromiter(given[i].keys(), np.int64, len(given[i]))
        to = np.fromiter(given[i].values(), np.float64, len(given[i]))
        weight = np.concatenate([np.ones((~held).sum()), np.full(len(at), 0.5)])
        return fit_logistic(np.vstack([z[i][~held], zp[i][at]]), np.concatenate([y[~held], to]), weight, l2=3.0, rounds=12)

    w = [fitted(0), fitted(1)]
    for _ in range(ROUNDS if 0 < prior < 1 and len(pool[0]) else 0):
        for i in (0, 1):
            p = predict(w[i], zp[i])
            for label, order, sure in ((1, np.argsort(-p, kind="stable"), p >= CONFIDENCE), (0, np.argsort(p, kind="stable"), p <= 1 - CONFIDENCE)):
                n = int(np.ceil(SHARE * len(p) * (prior if label else 1 - prior)))
                fresh = [int(j) for j in order if sure[j] and int(j) not in given[1 - i]][:n]
                given[1 - i].update(dict.fromkeys(fresh, label))
        w = [fitted(0), fitted(1)]
    out = [Scaled(m, s, c) for m, s, c in zip(mean, std, w)]
    for m, v in zip(out, views):
        if held.any() and 0 < y[held].mean() < 1:
            m.a, m.b = calibrate(m.raw(v[held]), y[held])
    return out[0], out[1]


def _views(c: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Both views of the rows, whose text, source, lang and n_chars are the columns from `at` on."""
    x = [content(t) for t in as_bytes(c.column(at))]
    m = [metadata(*r) for r in zip(*(c.column(at + i).to_pylist() for i in (1, 2, 3)))]
    return np.stack(x), np.stack(m)


def _view_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("cotraining")
    f = pa.list_(pa.float32())
    for b in (x for whole in batches for x in pieces(whole, 0)):
        x, m = (list(v.astype(np.float32)) for v in _views(b, 0))
        yield pa.RecordBatch.from_arrays([b.column(4), b.column(5), pa.array(x, f), pa.array(m, f)], ["y", "k", "x", "m"])


def _inputs(docs: DataFrame) -> DataFrame:
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select("doc_id", *((F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = MAX_LABELLED, unlabelled: int = MAX_UNLABELLED) -> tuple[Scaled, Scaled, float]:
    """Fits both views, and the log-odds of the labels, on bounded samples of the labelled documents and of the others,
    chosen by hashes."""
    d = _inputs(docs)
    y = labelled_sample(d, labels, "quality", labelled).select("doc_id", "y").distinct()
    n = d.count()
    share = min(1.0, unlabelled / max(1, n))
    known = d.join(F.broadcast(y), "doc_id")
    ids = labels.select("doc_id").distinct()
    rest = d.filter(F.pmod(F.xxhash64("doc_id", F.lit("pool")), F.lit(1_000_000)) < int(share * 1_000_000)).join(ids, "doc_id", "left_anti").withColumn("y", F.lit(-1))
    cols = ["text", "source", "lang", "n_chars", "y", F.xxhash64("doc_id", "text").alias("k")]
    got = mapped(known.select(*cols).unionByName(rest.select(*cols)), _view_rows, "y int, k long, x array<float>, m array<float>").toPandas().sort_values("k", kind="stable")  # the same order in every run
    widths = (PAIRS + SHAPES, SOURCE_BUCKETS + LANG_BUCKETS + LENGTHS)
    part = {}
    for name, rows in (("known", got[got["y"] >= 0]), ("pool", got[got["y"] < 0])):
        part[name] = tuple(np.vstack(rows[c].to_list()) if len(rows) else np.zeros((0, w), np.float32) for c, w in zip(("x", "m"), widths))
    y = got.loc[got["y"] >= 0, "y"].to_numpy(np.float64)
    del got
    a, b = co_train(part["known"], y, part["pool"])
    return a, b, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """One row per document: doc_id, p_content, p_metadata (calibrated), score (both views together, 0 to 1) and kept (score
    >= cut, so a tie is kept). Null texts and fields have places of their own. Without labels every score is one half and
    all is kept. Repeated rows are scored each; an empty table gives none; columns other than doc_id, text, source, lang
    and n_chars are not read, missing ones are null."""
    a, b, prior = fit(docs, labels)
    d = _inputs(docs)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("cotraining")
        for c in (x for whole in batches for x in pieces(whole, 1)):
            x, m = _views(c, 1)
            la, lb = a.logit(x), b.logit(m)
            p = [1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (la, lb, la + lb - prior)]
            yield pa.RecordBatch.from_arrays([c.column(0), *map(pa.array, p)], ["doc_id", "p_content", "p_metadata", "score"])

    out = mapped(d, run, f"doc_id {kind}, p_content double, p_metadata double, score double")
    return out.withColumn("kept", F.col("score") >= cut)
