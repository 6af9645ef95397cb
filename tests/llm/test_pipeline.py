"""The pipeline against its stages done one by one in plain Python."""

from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import langid, mixing, spm, toxicity
from loomgraph.llm.queries import tokenizer_path
from tests.llm.test_operators import brute_jaccard, corpus


def test_pipeline(spark, tmp_path):
    rows = [r[:5] for r in corpus(160, 4)]
    rows += [(1000 + r[0], r[1], *r[2:]) for r in rows[:30]] + [(2000, "12 34", "en", "s0", 5), (2001, None, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5], r[6]) for r in corpus(160, 4)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("toxic").collect()}
    left = [r for r in rows if r[0] not in toxic and r[0] not in (2000, 2001)]
    class_of = dict(zip((r[0] for r in left), (c[2] for c in brute_jaccard([(r[0], r[1]) for r in left]))))
    left = [r for r in left if class_of[r[0]] == r[0]]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(left, docs.schema)).collect()}
    t = spm.load(tokenizer_path()).transducer()
    text = {r[0]: r[1] for r in left}
    want = sorted((i, tuple(t.encode(text[i]))) for i, k in copies.items() for _ in range(k))
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == want


def test_null_and_repeated_ids_pass_the_join(spark):
    rows = [(1, "a b c d e f", None, None, 1), (1, "a b c d e f", None, None, 1), (2, "a b c d e f", None, None, 1), (None, "g h", None, None, 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "None", "None"]
    assert corpus_pipeline.mix_sources(spark, docs.filter(F.lit(False)), "").count() == 0
    assert langid.identify(docs, None).count() == 5


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("score", "size", "p_toxic", "p_junk", "lang_pred", "taken", "copies", "target", "n_switches", "row", "__copy", "h", "__rest", "sigs", "k_id")


def small_tree(spark, tmp_path, rows, schema=DOCS):
    at = str(tmp_path / "in")
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], r[5], r[6]) for r in corpus(60, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return docs, at


def test_unlike_texts_of_one_id_are_documents_of_their_own(spark):
    rows = [(1, "a b c d e f", None, None, 1), (2, "g h i j k l", None, None, 2), (2, "a b c d e f", None, None, 3), (2, "g h i j k l", None, None, 4), (3, "A B c d e f", None, None, 5), (None, "g h i j k l", None, None, 6), (None, "m n", None, None, 7), (None, "", None, None, 8), (None, "", None, None, 9)]
    got = sorted((r["n_chars"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()))
    assert got in ([1, 2, 7, 8, 9], [1, 4, 7, 8, 9])
    again = sorted((r["n_chars"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()))
    assert again == got


def test_columns_of_clashing_names_come_out_as_they_went_in(spark, tmp_path):
    rows = [(*r[:5], *(["mine"] * len(CLASH))) for r in corpus(60, 4)]
    docs, at = small_tree(spark, tmp_path, rows, DOCS + "".join(f", `{c}` string" for c in CLASH))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        assert {r[0] for c in CLASH for r in out.select(f"`{c}`").distinct().collect()} == {"mine"}, name


def test_empty_table_passes_all_stages(spark, tmp_path):
    docs, at = small_tree(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0, name
    assert corpus_pipeline.run(spark, at).count() == 0


def test_nulls_long_texts_and_repeated_rows_in_every_stage(spark, tmp_path):
    base = [r[:5] for r in corpus(60, 4)]
    long = (500, " ".join(f"{w}{i % 89}ing" for i in range(30_000) for w in ("bo", "ca")), "en", None, 1)
    odd = [(None, None, None, None, None), (None, "", None, None, 0), (501, None, "en", "s0", None), (502, "", None, "s0", 0), long, long, base[1]]
    docs, at = small_tree(spark, tmp_path, base + odd)
    kept = {name: stage(spark, docs, at).collect() for name, stage in corpus_pipeline.STAGES}
    toxic = {r[0] for r in corpus(60, 4) if r[6]}
    assert {r["doc_id"] for r in kept["toxicity"]} == {r[0] for r in base + odd} - toxic and len(kept["toxicity"]) == 60 + 7 - len(toxic)
    assert {r["doc_id"] for r in kept["language_id"]} == {r[0] for r in base} | {500}
    assert len(kept["ngram_jaccard"]) == 60 + 7 - 2
    assert all(len([r for r in kept["mixing"] if r["doc_id"] == i]) <= 6 for i in range(60)) and kept["mixing"]
    assert len(kept["sentencepiece"]) == 67 and sum(r["ids"] is None for r in kept["sentencepiece"]) == 2 and all(r["exact"] for r in kept["sentencepiece"] if r["ids"] is not None)
