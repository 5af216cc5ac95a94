"""op8: tokens of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteprism.llm.common import table
from siteprism.llm.registry import query
from siteprism.llm.token_counts import token_counts
from siteprism.llm.vocabulary import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), read(model))
