"""Tables as cells: one row for each filled field, columns known by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values

def is_number(kind: T.DataType) -> bool:
    """Whether a column's values travel as fixed-width numbers: numbers, flags, dates and times."""
    return isinstance(kind, (T.BooleanType, T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))


def number_kind(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "float" if isinstance(kind, T.FractionalType) else "int"


def _named(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def melted(frame: DataFrame, part: int, parse_text: bool = False) -> DataFrame:
    """part, col, kind, value, length of each filled text field. Long texts come as digests, before anything is shuffled."""
    fields = []
    for k, f in enumerate(frame.schema.fields):
        if is_number(f.dataType):
            continue
        text = _named(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(text)
        text = F.nullif(text.cast("string"), F.lit(""))
        fields.append(F.struct(F.lit(k).alias("col"), values.compact(text).alias("value"), F.length(text).alias("length")))
    if not fields:
        return frame.sparkSession.createDataFrame([], "part int, col int, kind string, value string, length int")
    cells = frame.select(F.explode(F.array(*fields)).alias("c")).where("c.value is not null")
    return cells.select(F.lit(part).alias("part"), "c.col", F.lit("text" if parse_text else "str").alias("kind"), "c.value", "c.length")


def melted_numbers(frame: DataFrame, part: int) -> DataFrame:
    """part, col, whole, real of each filled number, flag, date or time: fixed-width rows that need no text.

    whole holds integers, flags as 0 and 1, and times as microseconds; real holds fractions.
    """
    fields = []
    for k, f in enumerate(frame.schema.fields):
        if is_number(f.dataType):
            c, kind = _named(f.name), number_kind(f.dataType)
            if kind == "datetime":
                c = F.unix_micros(c.cast("timestamp"))
            whole = F.lit(None).cast("bigint") if kind == "float" else c.cast("bigint")
            real = c.cast("double") if kind == "float" else F.lit(None).cast("double")
            fields.append(F.struct(F.lit(k).alias("col"), whole.alias("whole"), real.alias("real")))
    if not fields:
        return frame.sparkSession.createDataFrame([], "part int, col int, whole long, real double")
    return frame.select(F.explode(F.array(*fields)).alias("c")).where("c.whole is not null or c.real is not null").select(F.lit(part).alias("part"), "c.*")


def counted_numbers(cells: DataFrame) -> DataFrame:
    return cells.groupBy("part", "col", "whole", "real").agg(F.count("*").alias("n"))


#: Up to so many columns, each is counted by itself: narrow keys and no rows made per cell. Wider tables would make plans
#: of hundreds of branches, and are melted. The counts are the same.
MELT_ABOVE = 40


def number_counts(frame: DataFrame, part: int) -> DataFrame:
    """counted_numbers of a frame's numbers, flags, dates and times."""
    fields = [(k, f) for k, f in enumerate(frame.schema.fields) if is_number(f.dataType)]
    if not fields or len(frame.schema.fields) > MELT_ABOVE:
        return counted_numbers(melted_numbers(frame, part))
    out = []
    for k, f in fields:
        c, kind = _named(f.name), number_kind(f.dataType)
        value = F.unix_micros(c.cast("timestamp")) if kind == "datetime" else c.cast("double" if kind == "float" else "bigint")
        counts = frame.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
        whole, real = (F.lit(None).cast("bigint"), F.col("v")) if kind == "float" else (F.col("v"), F.lit(None).cast("double"))
        out.append(counts.select(F.lit(part).alias("part"), F.lit(k).alias("col"), whole.alias("whole"), real.alias("real"), "n"))
    return union(out)


def text_counts(frame: DataFrame, part: int, parse_text: bool = False) -> DataFrame:
    """counted of a frame's texts."""
    fields = [(k, f) for k, f in enumerate(frame.schema.fields) if not is_number(f.dataType)]
    if not fields or len(frame.schema.fields) > MELT_ABOVE:
        return counted(melted(frame, part, parse_text))
    out = []
    for k, f in fields:
        text = _named(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(text)
        own = frame.select(F.nullif(text.cast("string"), F.lit("")).alias("t")).where("t is not null")
        counts = own.select(values.compact(F.col("t")).alias("value"), F.length("t").alias("length")).groupBy("value").agg(F.count("*").alias("n"), F.max("length").alias("length"))
        out.append(counts.select(F.lit(part).alias("part"), F.lit(k).alias("col"), F.lit("text" if parse_text else "str").alias("kind"), "value", "n", "length"))
    return union(out)


def as_text(numbers: DataFrame) -> DataFrame:
    """Number counts as part, col, value, n, in the canonical form that texts have."""
    round_ = (F.col("real") == F.floor("real")) & (F.abs("real") < 9.2e18)
    real = F.when(round_, F.col("real").try_cast("bigint").cast("string")).otherwise(F.col("real").cast("string"))
    return numbers.select("part", "col", F.coalesce(F.col("whole").cast("string"), real).alias("value"), "n")


def counted(cells: DataFrame) -> DataFrame:
    """value_counts: how many rows of a part's column hold each value. Partial sums are taken before the shuffle."""
    return cells.groupBy("part", "col", "kind", "value").agg(F.count("*").alias("n"), F.max("length").alias("length"))


def first_values(frame: DataFrame, part: int, n: int, columns: set[int] | None = None, most_rows: int | None = None) -> DataFrame:
    """part, col, value, times of the first n filled values of text columns (all, or the given ones), in row order.

    With most_rows only so many rows of each task are looked at, which is enough for most columns and sorts next to
    nothing. Either way each task keeps its own first n per column before the shuffle (the window has a rank limit).
    """
    names = [(k, f) for k, f in enumerate(frame.schema.fields) if isinstance(f.dataType, T.StringType) and (columns is None or k in columns)]
    if not names:
        return frame.sparkSession.createDataFrame([], "part int, col int, value string, times long")
    structs = [F.struct(F.lit(k).alias("col"), values.compact(F.nullif(_named(f.name), F.lit(""))).alias("value")) for k, f in names]
    rows = frame.select(F.monotonically_increasing_id().alias("row"), *(_named(f.name) for _, f in names))
    if most_rows is not None:
        rows = rows.where(F.pmod(F.col("row"), F.lit(1 << 33)) < most_rows)  # the upper bits number the task
    cells = rows.select("row", F.explode(F.array(*structs)).alias("c")).where("c.value is not null").select("row", "c.*")
    ranked = cells.withColumn("r", F.row_number().over(W.partitionBy("col").orderBy("row"))).where(F.col("r") <= n)
    return ranked.groupBy(F.lit(part).alias("part"), "col", "value").agg(F.count("*").alias("times"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
