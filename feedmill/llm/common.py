"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedmill.storage import Workspace, remove, settle, shared_dir

__all__ = ["Workspace", "carried", "field", "others", "remove", "row_of", "settle", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str) -> Column:
    """The top-level column of this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(names: list[str], results: tuple[str, ...]) -> list[str]:
    """Those of ``names`` that no result column replaces; as in Spark, names that differ in case only are equal."""
    taken = {r.lower() for r in results}
    return [n for n in names if n.lower() not in taken]


def carried(names: list[str]) -> Column:
    """The named columns as one struct; a null without names. Taken through an operator as one column and opened behind it."""
    return F.struct(*[field(n) for n in names]) if names else F.lit(None).cast("int")


def row_of(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no helper column of an operator can clash with them; ``row.*`` gives them back."""
    return carried(df.columns)
