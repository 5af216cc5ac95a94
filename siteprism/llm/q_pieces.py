"""op5: piece ids of every document, decoded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import table
from siteprism.llm.pieces import encode
from siteprism.llm.registry import query
from siteprism.llm.vocabulary import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op5_pieces")
def op5_pieces(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (decoding the ids gives the text again)."""
    out = encode(table(spark, sf_dir, "documents"), read(model))
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")
