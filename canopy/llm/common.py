"""What the operators of this package share: reading tables, the shared work folder, small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.plans.work import cut, work_path

#: White space of the text contracts: space and \t \n \v \f \r, nothing else.
WS = r"[ \t\n\x0B\f\r]"

__all__ = ["WS", "free_name", "free_names", "held", "once", "stage", "table", "words", "work_path"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts the lineage, and a lost executor loses nothing."""
    return cut(df, name)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS + "+"), lambda w: w != "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used: a lambda's argument stands for its value."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def free_names(df: DataFrame, *names: str) -> list[str]:
    """free_name of each."""
    return [free_name(df, n) for n in names]


#: Bits of a key filter, at most: what it broadcasts is never more than 32 MB. One row of it holds 32768 bits.
FILTER_BITS, ROW_BITS = 1 << 28, 1 << 15


def held(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose key (a hash, not null) may be in keys' only column, and those whose key is not there for certain.

    A bitmap with 16 bits a key, bounded by FILTER_BITS, is broadcast, so that rows without a partner need not be shuffled
    to learn that. Beyond the bound the first part grows and stays right. No keys leave all rows in the second part.
    """
    bits = max(ROW_BITS, min(FILTER_BITS, 1 << (16 * keys.count()).bit_length()))
    at, part, word, byte = (free_name(rows, f"_{x}") for x in ("at", "part", "word", "byte"))
    place = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(bits)).alias(at)).withColumn(part, F.floor(F.col(at) / ROW_BITS))
    bitmap = place.groupBy(part).agg(F.bitmap_construct_agg(F.col(at) % ROW_BITS).alias(word))
    both = rows.withColumn(at, F.pmod(key, F.lit(bits))).withColumn(part, F.floor(F.col(at) / ROW_BITS)).join(F.broadcast(bitmap), part, "left")
    here = F.substring(F.col(word), (F.floor(F.col(at) % ROW_BITS / 8) + 1).cast("int"), F.lit(1))
    both = both.withColumn(byte, F.coalesce(F.conv(F.hex(here), 16, 10).cast("int"), F.lit(0)))
    may = F.expr(f"shiftright(`{byte}`, cast(`{at}` % 8 as int)) & 1") == 1
    out = [F.col(f"`{c}`") for c in rows.columns]
    return both.filter(may).select(*out), both.filter(~may).select(*out)
