"""op7: the language of every document, learned on four fifths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import table
from siteprism.llm.language import fit, identify
from siteprism.llm.registry import query

FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fit(docs.filter(~held_out()))
    return identify(docs, network).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
