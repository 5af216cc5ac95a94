"""op3: quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteprism.llm.common import table
from siteprism.llm.quality import judge
from siteprism.llm.registry import query


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
