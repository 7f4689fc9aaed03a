"""op10: every page judged by rules and by its host's place in the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .urls import Rule, judge_urls

RULES = (
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
)


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)
