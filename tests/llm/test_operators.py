"""The ten operators on small tables: brute force, and nulls, empty and long texts, ties, repeated rows, empty tables and
columns of clashing names."""

import collections
import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import cotraining, jaccard, langid, licenses, linear, lm, mixing, multi_index, quality_rules, queries, spm, toxicity
from loomgraph.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} the" for i in range(20_000))
TEXTS = [None, "", " \n ", "one", "the cat sat on the mat", "the cat sat on the mat", "été ÉTÉ licensed under CC BY 4.0", LONG, LONG + " tail", "### *** $$$", "x\n\nx\nx", "all rights reserved all rights reserved"]


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "b"][i % 3], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    return table(spark, [*rows, rows[4], (None, "no id at all", None, None, None)])


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, [(i, 1 if i % 2 else 0, 0) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))


def corpus(n=300, seed=1):
    r = random.Random(seed)
    words = {"en": [f"{a}{b}ing" for a in "bcdfg" for b in "aeiou"], "de": [f"{a}{b}ßung" for a in "bcdfg" for b in "äöüie"]}
    out = []
    for i in range(n):
        lang = ["en", "de"][i % 2]
        w = [r.choice(words[lang]) for _ in range(r.randrange(60, 120))]
        toxic = i % 5 == 0
        if toxic:
            w[7:7] = ["idiot", "scum"]
        bad = i % 7 == 0
        out.append((i, " ".join(x + "###" for x in w) if bad else " ".join(w), lang, f"s{i % 4}", 500, int(not bad), int(toxic)))
    return out


@pytest.fixture(scope="module")
def clean(spark):
    c = corpus()
    return table(spark, [r[:5] for r in c]), table(spark, [(r[0], r[5], r[6]) for r in c], "doc_id long, quality int, toxic int")


# --- 1: embeddings


def test_near_vectors_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[200:260] = x[0] + 0.05 * rng.normal(size=(60, 16))
    x[260:280] = x[5]
    x[280:] = 3 * x[260:280] + 0.2 * rng.normal(size=(20, 16))
    rows_ = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [1.0])]
    got = rows(multi_index.near_vectors(table(spark, rows_, "vec_id long, embedding array<double>")), "vec_id")
    y = x / np.linalg.norm(x, axis=1)[:, None]
    link = (y @ y.T >= 0.9) & ~np.eye(300, dtype=bool)
    found = sum(r["n_links"] for r in got[:300])
    assert found >= 0.97 * link.sum() and all(r["n_links"] <= k for r, k in zip(got, link.sum(1)))
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in got[300:])
    assert not multi_index.near_vectors(table(spark, [], "vec_id long, embedding array<float>")).collect()


def test_near_vectors_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "LISTED", 16)
    monkeypatch.setattr(multi_index, "ASK_RATIO", 1)
    rng = np.random.default_rng(1)
    x = np.ones(8) + 0.01 * rng.normal(size=(120, 8))
    got = rows(multi_index.near_vectors(table(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")), "vec_id")
    assert {r["component_id"] for r in got} == {0}
    assert sum(r["n_links"] for r in got) >= 0.9 * 120 * 119 and max(r["n_links"] for r in got) <= 119


def test_near_vectors_by_regions(spark, monkeypatch):
    """Several groups of codewords, blocks and lengths at once, ties at the threshold, repeated and null ids."""
    for k, v in {"LISTED": 30, "ASK_RATIO": 2, "STEP": 16, "PER_CELL": 4, "FEW": 50}.items():
        monkeypatch.setattr(multi_index, k, v)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12))
    x[100:220] = x[0] + 0.12 * rng.normal(size=(120, 12))
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, [1.0, float(i)]) for i in range(30)] + [(5, [float(v) for v in x[5]]), (None, [float(v) for v in x[7]])]
    data += [(2000, [1.0, 0.0, 0.0]), (2001, [0.9, 0.19**0.5, 0.0]), (2002, [0.0, 0.0, 2.0])]
    got = multi_index.near_vectors(table(spark, data, "vec_id long, embedding array<double>").withColumn("row", F.lit(0)).withColumn("label", F.lit(1))).collect()
    v = [multi_index.unit(np.array(e)) for _, e in data]
    link = np.array([[i != j and len(a) == len(b) and a @ b >= 0.9 for j, b in enumerate(v)] for i, a in enumerate(v)])
    assert len(got) == len(data) and 0.95 * link.sum() <= sum(r["n_links"] for r in got) <= link.sum()
    ids = {r["vec_id"]: r for r in got}
    assert ids[2000]["n_links"] == link[-3].sum() and ids[2002]["n_links"] == 0
    assert sorted(r["n_links"] for r in got if r["vec_id"] == 5) == [link[5].sum()] * 2
    assert [(r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(7, False)]
    assert {r["component_id"] for r in got if r["vec_id"] is not None and 100 <= r["vec_id"] < 220} == {0}


def test_rank_is_the_place_in_the_traversal():
    rng = np.random.default_rng(2)
    index = multi_index.Index(rng.normal(size=(9, 3)), rng.normal(size=(7, 3)), 63)
    x = rng.normal(size=(20, 6))
    cells = index.traverse(x)
    for k in (0, 5, 62):
        assert (index.rank(x, cells[:, k]) == k).all()


def test_traversal_is_nearest_first():
    rng = np.random.default_rng(2)
    index = multi_index.Index(rng.normal(size=(9, 3)), rng.normal(size=(7, 3)), 20)
    x = rng.normal(size=(40, 6))
    d1, d2 = index.distances(x)
    for q, cells in enumerate(index.traverse(x)):
        total = (d1[q][:, None] + d2[q][None, :]).ravel()
        assert np.allclose(total[cells], np.sort(total)[:20])


# --- 2: mixing


def brute_targets(sizes, weights, epochs=3):
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > epochs * sizes[i]]
        for i in over or open_:
            out[i] = float(epochs * sizes[i]) if over else unit * weights[i]
            left -= out[i]
        if not over:
            break
        open_ -= set(over)
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 80], [0, 5], [1, 900, 3, 40, 7, 0, 2, 60], []])
def test_targets(spark, sizes):
    names = ["", "Z", "a", "b", "ß", "\U0001f642", "\uffff", None][: len(sizes)]
    names = sorted((x for x in names if x is not None), key=lambda x: x.encode()) + [x for x in names if x is None]
    t = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing._target_table(t, (5, 2, 1), 3).collect()}
    want = brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[x] for x in names] == pytest.approx(want)


def test_mix(spark, odd, none):
    got = rows(mixing.mix(odd))
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got) and len(got) == len(TEXTS) + 2
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    assert not mixing.mix(none).collect()
    many = table(spark, [(i, "w " * (i % 9), None, "ab"[i % 2], 0) for i in range(2000)])
    for _ in range(2):
        by = collections.defaultdict(float)
        target = {}
        for r in mixing.mix(many.withColumn("taken", F.lit(1))).collect():
            by[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        assert all(abs(by[s] - target[s]) <= 9 for s in target)


# --- 3: rules


def test_repeated_words():
    assert quality_rules.repeated_words("a b c a b c".split()) == 6
    assert quality_rules.repeated_words("a b c d a b".split()) == 0
    assert quality_rules.repeated_words("a a a a".split()) == 4
    assert quality_rules.text_stats("x\n\nx\nx y")[:4] == (4, 4, 0, 1)


def test_binomial_tail():
    assert quality_rules.binomial_tail(1, 3, 0.5) == pytest.approx(0.5)
    assert quality_rules.binomial_tail(3, 3, 0.5) == 1


def test_quality_rules(spark, odd, none, labels, clean):
    got = rows(quality_rules.quality_rules(odd, labels))
    assert len(got) == len(TEXTS) + 2 and got[0]["base_failed"] and not got[0]["kept"]
    assert not quality_rules.quality_rules(none, labels).collect()
    docs, y = clean
    many = docs.crossJoin(spark.range(12).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("k"))
    ys = y.crossJoin(spark.range(12).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("k"))
    out = quality_rules.quality_rules(many, ys, alpha=0.2).join(ys, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r["quality"]: r["k"] for r in out}
    assert share[1] > 0.8 and share[0] == 0


# --- 4: licenses


def test_phrases_and_blocks():
    w = licenses.words_of(b"CC BY cc by, All Rights Reserved!")
    assert [p for p, _ in licenses.phrase_places(w)] == [0, 2, 4]
    for n in (0, 1, 47, 48, 49, 64, 65, 200):
        covered = {i for a, b in licenses.blocks_of(n) for i in range(a, b)}
        assert covered == set(range(n))


def test_scanner_is_exact():
    r = random.Random(3)
    vocab = sorted({w for t in licenses.TEMPLATES.values() for w in licenses.words_of(t.encode())}) + [b"zz", b"yy", b"xx"]
    s = licenses.Scanner({w: r.randrange(50) for w in vocab})
    for _ in range(300):
        words = [r.choice(vocab) for _ in range(r.randrange(150))]
        if r.random() < 0.7:
            t = licenses.words_of(r.choice(list(licenses.TEMPLATES.values())).encode())
            at = r.randrange(len(words) + 1)
            words[at:at] = [w for w in t if r.random() < 0.97]
        want = sorted((label, a, b) for a, b in licenses.blocks_of(len(words)) for label, _, own, need in s.templates if len(own & set(words[a:b])) >= need)
        assert sorted(m[:3] for m in s.matches(words)) == want


def test_long_templates_and_long_texts(spark):
    r = random.Random(6)
    words = [f"t{r.randrange(260)}" for _ in range(500)]
    changed = [w if r.random() > 0.05 else "other" for w in words]
    s = licenses.Scanner({}, {"long": " ".join(words), "short": "so short a notice"})
    for before in (0, 13, 700, 5000):
        text = ["x"] * before + changed + ["y"] * 900
        got = s.matches([w.encode() for w in text])
        assert {m[0] for m in got} == {"long"} and any(a <= before and b >= before + 500 for _, a, b, _ in got)
    assert not s.matches([w.encode() for w in words[:300]])
    began = __import__("time").process_time()
    many = [b"cc", b"by"] * 500_000
    assert len(licenses.phrase_places(many)) == 500_000 and licenses.Scanner({}).matches(many) == []
    assert __import__("time").process_time() - began < 20
    t = spark.createDataFrame([("l", " ".join(words)), ("l", "another text of it"), (None, "x"), ("n", None)], "label string, text string")
    docs = table(spark, [(1, " ".join(changed), None, None, 0), (2, "This is another text of it.", None, None, 0), (3, "x", None, None, 0)])
    assert [g["labels"] for g in rows(licenses.license_scan(docs, t))] == ["l", "l", ""]


def test_license_scan(odd, none):
    got = {r["doc_id"]: r for r in rows(licenses.license_scan(odd))}
    assert got[6]["base_labels"] == "cc-by" and got[11]["n_base"] == 2 and got[11]["first_word"] == 0 and got[11]["last_word"] == 3
    assert got[0]["n_words"] == 0 and got[0]["first_word"] is None and got[0]["labels"] == ""
    assert not licenses.license_scan(none).collect()


# --- 5, 6: classifiers


def test_toxicity(odd, none, labels, clean):
    docs, y = clean
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs.withColumn("toxic", F.lit("x")), y).collect()}
    assert all(got[r[0]] == bool(r[6]) for r in corpus())
    assert len(rows(toxicity.toxicity(odd, labels))) == len(TEXTS) + 2
    assert not toxicity.toxicity(none, labels).collect()
    assert not any(r["toxic"] for r in toxicity.toxicity(docs, y.limit(0)).collect())


def brute_values(text):
    """The features of a text one by one."""
    import re

    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower())
    runs = [w[i : i + 4] for w in re.findall(rb"[^ \t\n\x0b\x0c\r]+", text.lower()) for i in range(len(w) - 3)]
    return words, list(zip(words, words[1:])), runs


def test_toxicity_values():
    """Equal features have equal values and others mostly not, whatever texts stand around them."""
    texts = [b"The cat, the CAT sat!!!!", None, b"", b"a bb ccc dddd \xc3\xa9\xc3\xa9", b"the cat###", b" \n "]
    v, owner, words = toxicity.values(texts)
    seen = collections.defaultdict(set)
    for i, t in enumerate(texts):
        parts = brute_values(t or b"")
        got = v[owner == i]
        for kind, part in enumerate(parts):
            own = got[(got >= kind * toxicity.VALUES) & (got < (kind + 1) * toxicity.VALUES)]
            assert len(own) == len(part)
            for x, y in zip(part, own.tolist()):
                seen[kind, x].add(y)
        assert words[i] == len(parts[0])
    assert all(len(y) == 1 for y in seen.values()) and len({y for ys in seen.values() for y in ys}) == len(seen)


def test_chain_uses_earlier_scores(clean):
    """Against a plain chain: features one by one, tested, and models fitted fold by fold."""
    docs, y = clean
    chain = toxicity.fit(docs, y)
    raw = corpus()
    sets = [set(toxicity.values([r[1].encode()])[0].tolist()) for r in raw]
    flags = {"junk": [1 - r[5] for r in raw], "toxic": [r[6] for r in raw]}
    n = collections.Counter(v for s in sets for v in s)
    tested = sum(c >= 3 for c in n.values())
    cut, k = linear.chi2_cut(toxicity.LEVEL / (2 * tested)), 0
    for j, f in enumerate(flags.values()):
        n1 = sum(f)
        pos = collections.Counter(v for s, t in zip(sets, f) if t for v in s)
        for v in n:
            a, b = pos[v], n[v] - pos[v]
            table = [(a, n[v] * n1), (b, n[v] * (300 - n1)), (n1 - a, (300 - n[v]) * n1), (300 - n1 - b, (300 - n[v]) * (300 - n1))]
            g = 2 * sum(o * math.log(o * 300 / e) for o, e in table if o)
            want = n[v] >= 3 and a * (300 - n1) > b * n1 and g > cut
            assert bool(chain.kinds[v] >> j & 1) == want, (v, j)
            k += want
    assert k > 4
    x = chain.features([r[1].encode() for r in raw])
    p = chain.scores(x)
    for j in range(2):
        w = chain.models[j]
        assert np.allclose(p[:, j], 1 / (1 + np.exp(-np.clip(np.hstack([x, p[:, :j]]) @ w[:-1] + w[-1], -40, 40))))
    assert len(chain.models[1]) == len(chain.models[0]) + 1
    assert not chain.features([None, b""]).any()


def test_fitting_the_chain_takes_no_memory_by_document(spark, monkeypatch):
    """The driver's peak beside what it holds for no documents; and the models are those of all labelled documents at once."""
    c = corpus(4000)
    docs, y = table(spark, [r[:5] for r in c]), spark.createDataFrame([(r[0], r[5], r[6]) for r in c], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "BLOCK", 256, raising=False)
    peaks = []
    for n in (200, 4000):
        tracemalloc.start()
        chain = toxicity.fit(docs.filter(F.col("doc_id") < n), y)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < 4 << 20, peaks
    x = chain.features([r[1].encode() for r in c]).astype(np.float32)
    fold = np.array([r[0] for r in docs.orderBy("doc_id").select(F.expr("pmod(xxhash64(doc_id, 'fold'), 5)")).collect()])
    before = np.zeros((len(c), 0), np.float32)
    for w, flag in zip(chain.models, (np.array([1 - r[5] for r in c]), np.array([r[6] for r in c]))):
        z = np.hstack([x, before])
        assert np.allclose(w, linear.fit_logistic(z, flag, l2=0.05), atol=1e-4)
        p = np.zeros(len(c))
        for f in range(toxicity.FOLDS):
            p[fold == f] = linear.predict(linear.fit_logistic(z[fold != f], flag[fold != f], l2=0.05), z[fold == f])
        before = np.hstack([before, p[:, None].astype(np.float32)])


def test_toxicity_tie(spark):
    """One clean and one toxic document that are alike: one half each, and nothing is rejected."""
    docs = table(spark, [(i, "the same words", None, None, 0) for i in range(20)])
    y = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, y).collect()
    assert len(got) == 20 and not any(r["toxic"] for r in got) and all(r["p_junk"] < 1e-6 for r in got)


def test_quality_classifier(odd, none, labels, clean):
    docs, y = clean
    got = {r["doc_id"]: r["kept"] for r in cotraining.quality_scores(docs, y).collect()}
    assert np.mean([got[r[0]] == bool(r[5]) for r in corpus()]) > 0.97
    assert len(rows(cotraining.quality_scores(odd, labels))) == len(TEXTS) + 2
    assert not cotraining.quality_scores(none, labels).collect()
    assert all(r["kept"] for r in cotraining.quality_scores(odd.select("doc_id", "text"), labels.limit(0)).collect())


def test_logistic():
    x = np.random.default_rng(0).normal(size=(400, 2))
    y = (x[:, 0] > 0.3).astype(float)
    assert ((linear.predict(linear.fit_logistic(x, y), x) > 0.5) == y).mean() > 0.97
    assert linear.predict(linear.fit_logistic(x, np.zeros(400)), x).max() < 0.01


# --- 7: pieces


def test_transducer_equals_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    t = spm.load(tokenizer_path()).transducer()
    r = random.Random(5)
    texts = [x for x in TEXTS if x is not None] + ["".join(r.choice("ab cde  \nthe ing 日é🙂0123.,#{}()=->_") for _ in range(r.randrange(80))) for _ in range(500)]
    for x in texts:
        ids = t.encode(x)
        assert ids == lib.encode(x) and t.decode(ids) == x


def test_unigram_shortest_path():
    def field(n, kind, v):
        return bytes([n << 3 | kind]) + v

    def piece(p, s, k=1):
        import struct

        body = field(1, 2, bytes([len(p.encode())]) + p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))
        return field(1, 2, bytes([len(body)]) + body)

    pieces = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -1.0, "aba": -6.0, "▁": -1.0, "▁a": -4.0}
    model = piece("<unk>", 0, 2) + b"".join(piece(p, s) for p, s in pieces.items()) + field(2, 2, b"\x02\x18\x01")
    t = spm.Transducer(model)

    def brute(s):
        if not s:
            return 0.0
        return min((brute(s[i:]) - pieces[s[:i]] for i in range(1, len(s) + 1) if s[:i] in pieces), default=math.inf)

    for s in ("a", "abab", "▁abba", "▁aba▁ba"):
        assert -sum(t.score[i] for i in t.path(s)) == pytest.approx(brute(s))
    assert t.decode(t.encode("ab a")) == "ab a"


def test_encode_table(spark, odd, none):
    m = spm.load(tokenizer_path())
    enc = spm.encode(odd, m)
    got = rows(enc)
    assert got[0]["ids"] is None and got[0]["n_tokens"] == 0 and got[1]["n_tokens"] == 0 and all(r["exact"] for r in got[1:])
    assert {(r["doc_id"], r["text"]) for r in rows(spm.decode(enc, m))} == {*enumerate(TEXTS), (None, "no id at all")}
    assert not spm.encode(none, m).collect()


def test_ids_that_are_no_pieces(spark):
    m = spm.load(tokenizer_path())
    t = table(spark, [(1, [-1]), (2, [None, 5]), (3, [10**9]), (4, []), (5, None), (6, m.transducer().encode("so it is"))], "doc_id long, ids array<long>")
    assert [r["text"] for r in rows(spm.decode(t, m))] == [None, None, None, "", None, "so it is"]


def test_op7_has_ids_that_decode(spark, tmp_path):
    texts = {1: "the cat sat", 2: "été 🙂 x", 3: "", 4: None}
    table(spark, [(i, t, None, None, None) for i, t in texts.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.op7_sentencepiece(spark, str(tmp_path)))
    t = spm.load(tokenizer_path()).transducer()
    assert {r["doc_id"]: None if r["ids"] is None else t.decode(r["ids"]) for r in got} == texts
    assert [r["exact"] for r in got] == [True, True, True, None] and all(len(r["ids"] or []) == r["n_tokens"] for r in got)


def test_exact_comes_from_decoding_each_text():
    t = spm.Transducer(spm.load(tokenizer_path()).data)
    assert t.encode_batch(["the cat", "a"])[2] == [True, True]
    t.text[t.encode("the cat")[0]] = b"?"  # the paths are remembered by now
    assert t.encode_batch(["the cat", "a"])[2] == [False, True]


# --- 8: Jaccard


def sets_of(text, n=5):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_jaccard(docs):
    s = [sets_of(t) for _, t in docs]
    link = [[i != j and bool(s[i]) and 100 * len(s[i] & s[j]) >= 90 * len(s[i] | s[j]) and bool(s[j]) for j in range(len(s))] for i in range(len(s))]
    out = []
    for i in range(len(s)):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            for j in range(len(s)):
                if link[k][j] and j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((len(s[i]), sum(link[i]), min(docs[j][0] for j in seen)))
    return out


@pytest.mark.parametrize("block", [2048, 8])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    r = random.Random(block)
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    base = [f"v{r.randrange(400)}" for _ in range(160)]
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(160)] = "changed"
        docs.append((100 + i, " ".join(w[: 160 - r.randrange(12)])))
    got = rows(jaccard.jaccard_join(table(spark, docs, "doc_id long, text string").withColumn("sigs", F.lit(1))))
    assert [(g["n_shingles"], g["n_similar"], g["component_id"]) for g in got] == brute_jaccard(docs)


def test_pages_with_a_common_frame_are_parted(spark, monkeypatch):
    """Pages that share 80 % of a frame collide in signatures; the prefix filter parts them, and true links stay."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 50)
    r = random.Random(2)
    frame, docs = [f"f{i}" for i in range(300)], []
    for i in range(400):
        docs.append((i, " ".join(w if r.random() > 0.04 else f"own{i}_{j}" for j, w in enumerate(frame))))
    docs += [(1000 + i, docs[i][1] + " tail") for i in range(10)]
    t = table(spark, docs, "doc_id long, text string")
    seen = []
    verify = jaccard._narrowed
    monkeypatch.setattr(jaccard, "_narrowed", lambda d, wide, *a: seen.append((wide.count(), (n := verify(d, wide, *a)).count())) or n)
    got = rows(jaccard.jaccard_join(t))
    assert [(g["n_shingles"], g["n_similar"], g["component_id"]) for g in got] == brute_jaccard(docs)
    assert seen and seen[0][0] > 100 and seen[0][1] < 0.5 * seen[0][0]


def test_a_text_held_very_often(spark):
    docs = [(1, "a b c d e f g")] * 500 + [(2, "a b c d e f g"), (3, " ".join(f"x{i}" for i in range(80))), (4, " ".join(f"x{i}" for i in range(79)))] * 2
    got = rows(jaccard.jaccard_join(table(spark, docs, "doc_id long, text string")))
    assert {(g["doc_id"], g["n_similar"], g["component_id"]) for g in got} == {(1, 501, 1), (2, 501, 1), (3, 3, 3), (4, 3, 3)}


def test_jaccard_odd(odd, none):
    assert len(jaccard.jaccard_join(odd).collect()) == len(TEXTS) + 2
    assert not jaccard.jaccard_join(none).collect()


# --- 9: language model


def brute_k(shorter, once):
    lo, hi = lm.K_RANGE
    for _ in range(100):
        k = math.sqrt(lo * hi)
        if sum(c * k / (c - 1 + k) for c in shorter) < once:
            lo = k
        else:
            hi = k
    return math.sqrt(lo * hi)


def brute_lm(docs, order, prior=None):
    """docs: (id, words and their end); the recursive definition on plain counts."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c, n = collections.Counter(), 0
    for i, w in docs:
        if not held(i):
            s = ["<s>", *w]
            c.update(tuple(s[j - k + 1 : j + 1]) for j in range(1, len(s)) for k in range(1, order + 1) if j - k + 1 >= 0)
            n += 1
    by = {k: [v for g, v in c.items() if len(g) == k] for k in range(1, order + 1)}
    prior = prior or [brute_k(by[k], by[k + 1].count(1)) for k in range(1, order)]
    total, known = sum(by[1]), len(by[1])
    c[("<s>",)] = n
    out = []
    for i, w in docs:
        s, base, score = ["<s>", *w], 0.0, 0.0
        for j in range(1, len(s)):
            p = (c[(s[j],)] + 0.1) / (total + 0.1 * (known + 1))
            base += math.log10(p)
            for k in range(2, min(order, j + 1) + 1):
                p = (c[tuple(s[j - k + 1 : j + 1])] + prior[k - 2] * p) / (c[tuple(s[j - k + 1 : j])] + prior[k - 2])
            score += math.log10(p)
        out.append((i, held(i), len(w), sum(c[(x,)] > 0 for x in w), total, round(base, 4), round(score, 4)))
    return out


def lm_rows(df):
    key = lambda t: (t[0] is None, t)
    return sorted(((g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 4), round(g["score"], 4)) for g in df.collect()), key=key)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_brute_force(odd, none, order, monkeypatch):
    docs = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in rows(odd)]
    key = lambda t: (t[0] is None, t)
    wide = odd.withColumn("score", F.lit("x")).withColumn("bucket", F.lit(-1)).withColumn("train_tokens", F.lit(0))
    assert lm_rows(lm.lm_scores(wide, block_tokens=500, order=order)) == sorted(brute_lm(docs, order), key=key)
    if order == 3:
        monkeypatch.setattr(lm, "BUCKET_ENTRIES", 4000)
        assert lm_rows(lm.lm_scores(odd, block_tokens=100, order=3, prior=[30.0, 2.0])) == sorted(brute_lm(docs, 3, [30.0, 2.0]), key=key)
        assert not lm.lm_scores(none).collect()


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_traversal_carries_its_state(order):
    """The automaton walked word by word in plain Python gives what the traversal from many places at once gives."""
    rng = np.random.default_rng(order)
    lengths = np.array([1, 300, 2, 75])
    tokens = np.minimum(rng.geometric(0.2, lengths.sum()) - 1, 29)
    words = np.arange(30, dtype=np.uint64) * np.uint64(977)
    numbers, counts = [tokens], [rng.integers(0, 4, 30).astype(float)]
    for ends, keys in lm.gram_keys(words, tokens, lengths, order):
        distinct, at = np.unique(keys, return_inverse=True)
        numbers.append(np.full(len(tokens), -1))
        numbers[-1][ends] = at
        counts.append(rng.integers(0, 3, len(distinct)).astype(float))
    for m in range(order - 1, 0, -1):  # what is seen has seen parts
        for i in np.flatnonzero(numbers[m] >= 0):
            if counts[m][numbers[m][i]]:
                counts[m - 1][numbers[m - 1][i]] = max(1, counts[m - 1][numbers[m - 1][i]])
                if m > 1 or i > 0:
                    counts[m - 1][numbers[m - 1][i - 1]] = max(1, counts[m - 1][numbers[m - 1][i - 1]])
    start = np.cumsum(lengths) - lengths
    a = lm.compiled(counts, numbers, start, 3, 100, 20, [5.0, 2.0, 1.0])
    want = []
    for s, n in zip(start, lengths):
        state = 1 if order > 1 else 0
        for i in range(s, s + n):
            w, m = 0.0, state
            while m and not (numbers[m][i] >= 0 and a.arcs[m][numbers[m][i]]):
                w += a.start_fail if m == 1 and i == s else a.fails[m - 1][numbers[m - 1][i - 1]]
                m -= 1
            want.append(w + a.weights[m][numbers[m][i]])
            state = min(m + 1, order - 1) if m or a.arcs[0][numbers[0][i]] else 0
    for stride in (1, 7, 64):
        assert np.allclose(lm.traverse(a, numbers, start, lengths, 3, stride), want)
    full = np.concatenate([[a.weights[min(order - 1, j)][numbers[min(order - 1, j)][s + j]] if j else a.weights[min(order, 2) - 1][numbers[min(order, 2) - 1][s]] for j in range(n)] for s, n in zip(start, lengths)]) if order < 3 else None
    assert full is None or np.allclose(full, want)


def test_lm_coding():
    rng = np.random.default_rng(1)
    for keys in ([], [0], [5, 5 + 2**40], np.sort(rng.integers(7, 2**56, 3000)), np.arange(9, 400)):
        k = np.array(keys, np.uint64)
        assert (lm.unpacked(lm.packed(k, 0), 0) == k).all() and (lm.unpacked(lm.packed(k[k >= 5], 5), 5) == k[k >= 5]).all()
    v = np.array([0, 1, 254, 255, 256, 2**40, 3], np.uint64)
    assert (lm.grown(lm.shrunk(v)) == v).all() and not len(lm.grown(lm.shrunk(v[:0])))
    assert (lm.expanded(lm.squeezed(v[:5])) == v[:5].astype(np.int64)).all() and not len(lm.expanded(lm.squeezed(v[:0])))


def test_op9_sees_two_words_back(spark, tmp_path):
    texts = [(i, "a b c" if i % 2 else "d b e") for i in range(40)]
    table(spark, [(*t, None, None, 5) for t in texts + [(50, "a b c"), (52, "a b e")]]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in queries.op9_lm_scores(spark, str(tmp_path)).collect()}
    assert got[50] > got[52] + 0.1


# --- 10: language ID


def test_forward_backward():
    rng = np.random.default_rng(0)
    lengths, k = [5, 0, 130, 1, 64], 3
    p, t = rng.normal(size=(sum(lengths), k)) * 5, rng.normal(size=(k, k))
    g, at = langid.forward_backward(p, t, np.array(lengths)), 0
    for n in lengths:
        e, tr = np.exp(p[at : at + n]), np.exp(t)
        a, b, x, y = np.zeros((n, k)), np.zeros((n, k)), np.full(k, 1 / k), np.ones(k)
        for i in range(n):
            x = (x @ tr) * e[i]
            a[i] = x = x / x.sum()
        for i in range(n - 1, -1, -1):
            b[i] = y
            y = tr @ (e[i] * y)
            y /= y.sum()
        if n:
            m = a * b
            assert np.allclose(m / m.sum(1, keepdims=True), g[at : at + n])
        at += n


def test_training_gradient():
    """Expected minus seen transitions is the derivative of the likelihood summed over all label sequences."""
    import itertools

    rng = np.random.default_rng(4)
    k, lengths = 3, [4, 1, 0, 3]
    p, t, y = rng.normal(size=(8, k)), rng.normal(size=(k, k)), rng.integers(0, k, 8)

    def loss(trans):
        out, at = 0.0, 0
        for n in lengths:
            e, z, gold = p[at : at + n], 0.0, 0.0
            for path in itertools.product(range(k), repeat=n + 1 if n else 0):  # the label before the first word is hidden
                s = math.exp(sum(trans[a, b] + e[i, b] for i, (a, b) in enumerate(zip(path, path[1:]))))
                z += s
                gold += s if tuple(path[1:]) == tuple(y[at : at + n]) else 0.0
            out += math.log(z) - math.log(gold) if n else 0.0
            at += n
        return out

    g, expected = langid.forward_backward(p, t, np.array(lengths), block=2, moves=True)
    grad = expected - langid.seen_moves(y, np.array(lengths), t)
    for a in range(k):
        for b in range(k):
            d = np.zeros((k, k))
            d[a, b] = 1e-5
            assert (loss(t + d) - loss(t - d)) / 2e-5 == pytest.approx(grad[a, b], abs=1e-5)
    assert expected.sum() == pytest.approx(8)


def test_excerpts_cover_whole_texts():
    words = [str(i) for i in range(5000)]
    runs = langid.excerpt(words, 3)
    flat = [int(x) for r in runs for x in r]
    assert len(flat) == langid.MAX_WORDS_PER_DOC and flat == sorted(set(flat)) and flat[-1] > 3000
    assert [x for r in langid.excerpt(words[:50], 1) for x in r] == words[:50] and langid.excerpt([], 1) == []


def test_language_id(odd, none, clean):
    docs, _ = clean
    got = rows(langid.language_id(docs.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x")), per_lang=60))
    assert np.mean([g["lang_pred"] == g["lang"] for g in got]) > 0.98
    assert len(rows(langid.language_id(odd))) == len(TEXTS) + 2
    bad = {r["doc_id"]: r for r in rows(langid.language_id(odd))}
    assert bad[0]["lang_pred"] == bad[1]["lang_pred"] == bad[9]["lang_pred"] == "und"
    assert not langid.language_id(none).collect()
    assert {g["lang_pred"] for g in rows(langid.identify(odd, None))} == {"und"}


def test_code_switch():
    f = langid.train([(langid.excerpt(x[1].split(), i), x[2]) for i, x in enumerate(corpus(80, 2))])
    en, de = corpus(2, 9)
    words = en[1].replace("###", "").split()[:40] + de[1].split()[:40]
    g, _, _ = f.marginals([words])
    lab = g.argmax(1)
    assert (lab[:38] == f.langs.index("en")).all() and (lab[42:] == f.langs.index("de")).all()


def test_every_language_is_learned(spark):
    r = random.Random(8)
    words = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for k in range(70)}
    docs = [(100 * k + i, " ".join(r.choice(words[x]) for _ in range(25)), x, None, None) for k, x in enumerate(words) for i in range(6 if k < 60 else 3)]
    t = table(spark, docs)
    assert {lang for _, lang in langid.sample_rows(t)} == {*words}
    got = rows(langid.identify(t, langid.train(langid.sample_rows(t))))
    assert np.mean([g["lang_pred"] == g["lang"] for g in got]) > 0.97 and {g["lang_pred"] for g in got} == {*words}


# --- all


def test_columns_of_clashing_names(spark, odd, labels):
    """Columns that operators make themselves, already there in the input: the results are those without them."""
    names = ["size", "score", "kept", "stratum", "n_words", "n_symbols", "matches", "labels", "words", "tokens", "block", "bucket", "held", "ids", "exact", "n_bytes", "y", "x", "m", "p_content", "sigs", "row", "n", "f1", "lang_pred", "p_toxic", "source_size", "target", "copies", "taken", "n_switches", "base_failed"]
    wide = odd.withColumns({c: F.lit("mine") for c in names})
    m = spm.load(tokenizer_path())
    runs = {
        "mixing": lambda d: mixing.mix(d, ids_only=True), "rules": lambda d: quality_rules.quality_rules(d, labels), "licenses": licenses.license_scan, "quality": lambda d: cotraining.quality_scores(d, labels).drop("score", "p_content"),
        "pieces": lambda d: spm.encode(d, m), "jaccard": jaccard.jaccard_join, "lm": lm.lm_scores, "language": lambda d: langid.language_id(d).select("doc_id", "lang_pred"), "toxicity": lambda d: toxicity.toxicity(d, labels).select("doc_id", "toxic"),
    }
    for name, f in runs.items():
        a, b = (sorted(map(repr, f(d).collect())) for d in (odd, wide))
        assert a == b, name


def test_very_long_texts(spark, labels):
    """A text of a million words, and one word of a million letters, beside short ones."""
    long, word = "the cat sat on 1 mat " * 170_000, "x" * 1_000_000
    d = table(spark, [(1, long, "en", "a", 1), (2, word, "en", "b", 2), (3, "the cat", "en", "a", 3)])
    assert [r["n_words"] for r in rows(quality_rules.quality_rules(d, labels))] == [1_020_000, 1, 2]
    assert [r["n_words"] for r in rows(licenses.license_scan(d))] == [1_020_000, 1, 2]
    assert [r["n_tokens"] for r in rows(lm.lm_scores(d))] == [1_020_001, 2, 3]
    assert [r["n_shingles"] for r in rows(jaccard.jaccard_join(d))] == [6, 1, 1]
    assert [r["lang_pred"] for r in rows(langid.language_id(d))] == ["en"] * 3
    assert len(rows(cotraining.quality_scores(d, labels))) == len(rows(toxicity.toxicity(d, labels))) == 3
    assert [r["exact"] for r in rows(spm.encode(d, spm.load(tokenizer_path())))] == [True] * 3
