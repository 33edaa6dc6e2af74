"""Queries of the text problems (6 to 8) over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.frames import read_table
from . import encode, pack, sentences


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document's text."""
    return encode.encode(read_table(spark, d, "documents"))


def p7_bins(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in the containers of each kind."""
    return pack.pack_documents(read_table(spark, d, "documents"), read_table(spark, d, "pack_capacities"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """How many containers each kind took, against the least possible."""
    return pack.report(p7_bins(spark, d), read_table(spark, d, "pack_capacities"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document."""
    return sentences.split(read_table(spark, d, "documents"))


QUERIES = {"p6_ids": p6_ids, "p7_bins": p7_bins, "p7_report": p7_report, "p8_found": p8_found}
ORACLES: dict[str, str] = {}
