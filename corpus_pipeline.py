"""A cleaned training corpus: toxic texts out, near copies out, repeated passages cut, benchmark texts out, encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm import decontaminate, jaccard, pieces, suffixes, toxicity
from siteprism.llm.common import restored, shared_dir, table
from siteprism.llm.q_pieces import MODEL
from siteprism.llm.vocabulary import read

#: Near copies: five-word shingles, similarity of 0.8 and more.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among them, doesn't call toxic.

    NULL and empty texts hold nothing toxic and stay; rows with a NULL or repeated id are judged one by one; long texts are
    read whole; an empty table gives an empty one.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return restored(toxicity.severity(docs, model, carry=True).filter("not toxic"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    NULL texts and texts without words are in no group and stay.  Rows without an id stay, as no id tells which of them to
    keep.  Rows that repeat an id are documents of their own: of a group's rows with the smallest id one text stays, and
    of equal rows one.  An empty table gives an empty one.
    """
    found = jaccard.classes(docs, SHINGLE, PERCENT).filter("label IS NOT NULL AND doc_id IS NOT NULL")
    stays = found.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    empty = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    apart = empty | F.col("doc_id").isNull()
    own = docs.select("*", jaccard.text_key().alias("_text_key")).alias("d")
    first = stays.withColumnsRenamed({"doc_id": "_first", "text_key": "_first_key"})
    one = own.filter(~apart).join(first, (F.col("d.doc_id") == F.col("_first")) & (F.col("_text_key") == F.col("_first_key")), "left_semi")
    one = one.drop("_text_key").dropDuplicates(["doc_id", "text"])
    return one.select(*docs.columns).unionByName(docs.filter(apart))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a text of which nothing is left goes, one that was empty before stays.

    A cut may split a character; broken bytes go with it.  n_chars counts what stays.
    """
    out = suffixes.kept(docs, carry=True, as_text=True).filter("n_bytes = 0 or n_removed < n_bytes")
    same = F.col("n_removed") == 0
    chars = F.when(same, F.col("row.columns.n_chars")).otherwise(F.length("kept").cast("long"))
    return restored(out.withColumn("text", F.col("kept")), docs.columns, n_chars=chars)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words comes from the benchmark.

    NULL and empty texts have no words and stay; rows with a NULL or repeated id are judged one by one; long texts are read
    whole; an empty table or benchmark changes nothing.
    """
    hits = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return restored(decontaminate.counts(hits).filter("not contaminated"), docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every document, a row per row (NULL and repeated ids too).

    A NULL text has NULL ids, an empty one none, both no tokens; an empty table gives an empty one.
    """
    out = pieces.encode(docs, read(MODEL))
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("pieces", encode_pieces),
]

#: Models are fitted and texts encoded on the way: no SQL says that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
