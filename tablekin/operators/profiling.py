"""Column statistics from value_counts: type, filled and distinct counts, length, identifier shape, type tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values
from ..functions.dialects import Dialect

TOKENS = 12


def parsed(counts: DataFrame) -> DataFrame:
    """value_counts with `as_kind`: what each value is, text being parsed value by value."""
    return counts.withColumn("as_kind", F.when(F.col("kind") == "text", values.kind_of_text(F.col("value"))).otherwise(F.col("kind")))


def column_types(counts: DataFrame) -> DataFrame:
    """part, col, type: one kind for all values, float for int with float, string for every other mix."""
    is_ = lambda *k: F.bool_and(F.col("as_kind").isin(*k))
    kind = F.when(is_("bool"), "bool").when(is_("time"), "datetime").when(is_("int"), "int").when(is_("int", "float"), "float").otherwise("string")
    return parsed(counts).groupBy("part", "col").agg(kind.alias("type"))


def canonical_counts(counts: DataFrame, types: DataFrame) -> DataFrame:
    """part, col, value, n, length, type with values in the canonical form of their column's type.

    types has one row per column of the schema, which bounds what is broadcast. Only forms of parsed text can fall
    together (7 and 07); where a column stays text nothing is counted anew.
    """
    form = values.canonical(F.when(F.col("type").isin("int", "float", "bool"), F.col("as_kind")).otherwise("str"), F.col("value"))
    out = parsed(counts).join(F.broadcast(types), ["part", "col"]).select("part", "col", form.alias("value"), "n", "length", "type")
    return out.groupBy("part", "col", "value").agg(F.sum("n").alias("n"), F.max("length").alias("length"), F.first("type").alias("type"))


def number_stats(numbers: DataFrame) -> DataFrame:
    """part, col, filled, distinct and whether all values are whole, of columns that travel as numbers."""
    round_ = F.col("real").isNull() | ((F.col("real") == F.floor("real")) & (F.abs("real") < 9.2e18))
    return numbers.groupBy("part", "col").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct"), F.bool_and(round_).alias("all_whole"))


def sample_signs(samples: DataFrame, dialect: Dialect) -> DataFrame:
    """part, col, found and what the first values say: share that looks like an id, share of dates and of dates or times."""
    share = lambda p: F.sum(F.when(p, F.col("times")).otherwise(0)) / F.sum("times")
    v = F.col("value")
    date = v.rlike(values.ISO_DATE)
    return samples.groupBy("part", "col").agg(
        F.sum("times").alias("found"), share(dialect.looks_like_id(v)).alias("id_share"), share(date).alias("date_share"), share(date | v.rlike(values.ISO_DATETIME)).alias("time_share")
    )


def column_stats(counts: DataFrame) -> DataFrame:
    """part, col, type, filled, distinct, longest: one row per column that holds anything."""
    return counts.groupBy("part", "col").agg(F.first("type").alias("type"), F.sum("n").alias("filled"), F.count("*").alias("distinct"), F.max("length").alias("longest"))


def text_type(id_share: float, date_share: float, time_share: float, dialect: Dialect) -> tuple[str, bool]:
    """(type, id_like) of a text column, from its sample."""
    if id_share >= dialect.id_share:
        return "id", True
    return "date" if date_share == 1 else "datetime" if time_share >= 0.95 else "string", False


def token_counts(counts: DataFrame) -> DataFrame:
    """part, col, token, rows: by the first three characters of values of 15 or 18 characters."""
    ids = counts.where(F.length("value").isin(15, 18))
    return ids.groupBy("part", "col", F.substring("value", 1, 3).alias("token")).agg(F.sum("n").alias("rows"))


def top_tokens(tokens: DataFrame, by: list[str], n: int = TOKENS) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("rows"), "token"))
    return tokens.withColumn("rank", rank).where(F.col("rank") <= n)
