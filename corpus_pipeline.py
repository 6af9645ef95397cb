"""The corpus pipeline: five operators, one after the other, over all documents.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept, which are written as Parquet
and read again between the stages. Stages decide row by row: rows with a null id, or of one id with unlike texts, are
documents of their own. Columns that documents has beside doc_id, text, lang and source travel through a stage packed into
one, so whatever they are called they come out as they went in. An empty table passes all stages as an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import jaccard, langid, mixing, spm, toxicity
from loomgraph.llm.common import scratch, small, stored
from loomgraph.llm.queries import tokenizer_path

#: Documents whose main language has less than this share of their words go.
LANGUAGE_SHARE = 0.4
#: Columns that operators may read under their own names.
READ = ("doc_id", "text", "lang", "source")


def _packed(docs: DataFrame) -> DataFrame:
    """docs with READ, and the other columns in one called __rest."""
    rest = [docs[c] for c in docs.columns if c not in READ]
    return docs.select(*(docs[c] for c in READ), *([F.struct(*rest).alias("__rest")] if rest else []))


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of _packed(docs), whatever else df holds, with the columns of docs."""
    return df.select(*(F.col(c) if c in READ else F.col("__rest").getField(c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go: those with a probability above one half, so a tie stays. Null and
    empty texts stay, as does everything where there are no labels; repeated rows stay or go together."""
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(toxicity.score(_packed(docs), chain).filter(F.col("p_toxic") <= 0.5), docs)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which no language has LANGUAGE_SHARE of the words, go; so null and empty texts do.
    Where no document has a language, nothing is learned and nothing goes."""
    field = langid.train(langid.sample_rows(docs.filter(~langid.held_out())))
    if field is None:
        return docs
    found = langid.identify(_packed(docs), field)
    return _unpacked(found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LANGUAGE_SHARE)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id stays, null ids last; of several rows of that id and
    component the one whose text has the smallest hash, and of rows equal in both the one whose columns have. Rows without
    words are linked with nothing and all stay."""
    none, name, h = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.col("text").cast("string"))
    key = F.struct(none.alias("none"), F.col("doc_id").alias("id"), h.alias("h"))
    found = jaccard.jaccard_join(docs.select(key.alias("__key"), "text"), "__key").filter("n_shingles > 0")
    found = stored(found.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n")), "near")
    k = [F.col("doc_id.none").alias("k_none"), F.coalesce(F.col("doc_id.id").cast("string"), F.lit("")).alias("k_id"), F.col("doc_id.h").alias("k_h")]
    gone = found.filter("least < doc_id").select(*k)
    again = found.filter("least = doc_id AND n > 1").select(*k)
    n_gone, n_again = gone.count(), again.count()
    rows = docs.select(F.struct(*docs.columns).alias("row"), none.alias("k_none"), name.alias("k_id"), h.alias("k_h"))
    kept = rows.join(small(gone, n_gone), ["k_none", "k_id", "k_h"], "left_anti")
    if not n_again:
        return kept.select("row.*")
    repeated = small(again, n_again)
    once = kept.join(repeated, ["k_none", "k_id", "k_h"], "left_semi").groupBy("k_none", "k_id", "k_h").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.join(repeated, ["k_none", "k_id", "k_h"], "left_anti").select("row.*").unionByName(once.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is a source; null and empty texts have no words and are
    taken with their source's whole passes."""
    taken = mixing.mix(_packed(docs)).filter("copies > 0")
    return _unpacked(taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document that is left; null ids for a null text, none for an empty one. Columns beside doc_id
    and text are not read."""
    return spm.encode(docs, spm.load(tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as made:  # what the stage makes meanwhile goes, and what it worked on; its result stays
            kept = stored(stage(spark, docs, sf_dir), name)
            made[:] = [docs, *(x for x in made if x is not kept)]
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
