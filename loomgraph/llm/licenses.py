"""License scan: an exact set-similarity join of text blocks with license templates.

For each template a text is cut into blocks of BLOCK words, each beginning STRIDE words after the one before it, or of twice
as many, four times and so on: the least with which every passage as long as the template lies in some block whole. A
block matches the template if it holds at least THRESHOLD of the template's distinct words. Words are ordered by their frequency in all texts, rarest first. A template of m words that
needs t of them is matched only by blocks with one of its m - t + 1 rarest words (prefix filter); blocks of fewer than t
words are too small (length filter); and a block whose first shared word stands at place p of the template can share at
most m - p of them (positional filter). What passes is verified, so no match is lost and none is false."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, mapped, pieces

#: Places where these words stand consecutively give these labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's templates: notices as they stand in texts.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under cc by sa 4.0",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "proprietary": "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential",
}
THRESHOLD = 0.9
#: Words of a block and from one block to the next, for templates of up to BLOCK - STRIDE + 1 words.
BLOCK, STRIDE = 48, 16
#: Bytes of all templates together, at most: they travel to every task.
MAX_TEMPLATE_BYTES = 64 << 20
#: Upper-case letters lowered; every ASCII character but letters and digits separates words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


def needed(m: int, threshold: float = THRESHOLD) -> int:
    """Words of a template of m distinct words that a block must hold."""
    return max(1, -int(-round(m * threshold * 1e9) // 1e9))


def scale_of(words: int) -> int:
    """How many times BLOCK and STRIDE a template of so many words takes: a power of two."""
    k = 1
    while words > k * (BLOCK - STRIDE) + 1:
        k *= 2
    return k


def blocks_of(n: int, scale: int = 1) -> list[tuple[int, int]]:
    """Word ranges of the blocks of a text of n words."""
    block, stride = BLOCK * scale, STRIDE * scale
    if n <= block:
        return [(0, n)] if n else []
    return [(i, min(n, i + block)) for i in range(0, n - block + stride, stride)]


class Scanner:
    """Templates ordered by the corpus frequency of their words."""

    def __init__(self, frequency: dict[bytes, int], templates: dict[str, str] | list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        rank = lambda w: (frequency.get(w, 0), w)
        self.templates = []
        #: by scale, the words that a template's prefix holds: their templates and places
        self.prefix: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for label, text in templates.items() if isinstance(templates, dict) else templates:
            all_words = words_of(text.encode())
            words = sorted(set(all_words), key=rank)
            if not words:
                continue
            t = needed(len(words), threshold)
            own = self.prefix.setdefault(scale_of(len(all_words)), {})
            for p in range(len(words) - t + 1):
                own.setdefault(words[p], []).append((len(self.templates), p))
            self.templates.append((label, words, frozenset(words), t))

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, containment) of every block that matches a template."""
        own, out = set(words), []
        for scale, prefix in self.prefix.items():
            hits = prefix.keys() & own
            if hits:
                out += self._at(words, scale, prefix, hits)
        return out

    def _at(self, words: list[bytes], scale: int, prefix: dict, hits: set[bytes]) -> list[tuple[str, int, int, float]]:
        block, stride = BLOCK * scale, STRIDE * scale
        ranges, out = blocks_of(len(words), scale), []
        near = {i for p, w in enumerate(words) if w in hits for i in range(max(0, (p - block) // stride), min(p // stride + 1, len(ranges)))}
        for k in sorted(near):
            a, b = ranges[k]
            held = set(words[a:b])
            first: dict[int, int] = {}
            for w in hits & held:
                for t, p in prefix[w]:
                    first[t] = min(p, first.get(t, p))
            for t, p in first.items():
                label, order, own, need = self.templates[t]
                if len(held) < need or len(order) - p < need:
                    continue
                share = len(own & held)
                if share >= need:
                    out.append((label, a, b, share / len(own)))
        return out


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place of a phrase, overlapping ones included."""
    out = []
    for phrase, label in phrases.items():
        p = phrase.encode().split()
        at = -1
        for _ in range(words.count(p[0])):
            at = words.index(p[0], at + 1)
            if words[at : at + len(p)] == p:
                out.append((at, label))
    return out


def templates_of(table: DataFrame) -> list[tuple[str, str]]:
    """The templates of a table (label, text), whose size is checked. Null labels and texts are left out; a label may have
    several texts."""
    t = table.filter("label IS NOT NULL AND text IS NOT NULL").select("label", "text").distinct()
    size = t.agg(F.sum(F.octet_length("text") + F.octet_length("label"))).first()[0] or 0
    if size > MAX_TEMPLATE_BYTES:
        raise ValueError(f"the templates hold {size} bytes, more than {MAX_TEMPLATE_BYTES}")
    return [(r["label"], r["text"]) for r in t.orderBy("label", "text").collect()]


def frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """How often each template word occurs in all texts; as many entries as the templates have words."""
    vocabulary = frozenset(w for _, t in templates for w in words_of(t.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in (x for whole in batches for x in pieces(whole, 0)):
            for t in as_bytes(b.column(0)):
                c.update(filter(vocabulary.__contains__, words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    got = mapped(docs.select(F.col("text").cast("string").alias("text")), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in got}


def license_scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of PHRASES), first_word and last_word (the smallest and largest
    start of these, null without any), base_labels, labels (with those of matched templates; both distinct, sorted,
    comma-joined, empty if there are none), score (1 with a base label, else the largest containment that matched, else
    0), matches (label, first word, end, containment of each matching block). templates: label and text, or a table of
    these columns. A null text is an empty one; a text however long is scanned whole; an empty table gives none. Repeated rows
    each have their row; columns other than doc_id and text are not read."""
    templates = templates_of(templates) if isinstance(templates, DataFrame) else list(templates.items())
    scanner = Scanner(frequencies(docs, templates), templates, threshold)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in pieces(whole, 1)):
            rows = []
            for t in as_bytes(b.column(1)):
                words = words_of(t)
                base = phrase_places(words) if words else []
                found = scanner.matches(words)
                starts = [i for i, _ in base]
                own = {x for _, x in base}
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {m[0] for m in found})), 1.0 if base else max((m[3] for m in found), default=0.0), [dict(zip(("label", "first", "end", "containment"), m)) for m in found]))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return mapped(d, run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:long,end:long,containment:double>>")
