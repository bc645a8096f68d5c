"""Tables of other systems: by request parameters, by JDBC, and keyed archives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gemflow.session import materialise


def _values(text: str) -> list[str]:
    return [v.strip().strip('"') for v in text.strip()[1:-1].split(",") if v.strip()]


def _test(df: DataFrame, column: str, rule: str) -> Column:
    """One condition such as ``eq.x``, ``not.in.(a,b)``, ``ilike.*gold*``; values take the column's type."""
    if rule.startswith("not."):
        return ~_test(df, column, rule[4:])
    name, _, value = rule.partition(".")
    kind, c = dict(df.dtypes)[column], F.col(column)
    typed = lambda v: F.lit(v).cast(kind)
    if name == "in":
        return c.isin(*[typed(v) for v in _values(value)])
    if name == "is":
        return c.isNull() if value == "null" else c == typed(value)
    if name in ("like", "ilike"):
        pattern = value.replace("*", "%")
        return c.ilike(pattern) if name == "ilike" else c.like(pattern)
    return {"eq": c.eqNullSafe if value == "null" else c.__eq__, "neq": c.__ne__, "gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}[name](typed(value))


def request(df: DataFrame, params: dict[str, str]) -> DataFrame:
    """A table read by request parameters: ``select``, ``order``, ``limit``, ``offset``, ``or=(a.eq.1,b.ilike.*x*)`` and a rule per column.

    Everything becomes plain DataFrame operations, so filters and columns reach the scan. An unknown column or rule is an error.
    """
    out = df
    for column, rule in params.items():
        if column in ("select", "order", "limit", "offset"):
            continue
        if column == "or":
            any_ = F.lit(False)
            for part in re.findall(r"(\w+)\.((?:not\.)?\w+\.(?:\([^)]*\)|[^,()]*))", rule):
                any_ = any_ | F.coalesce(_test(df, *part), F.lit(False))
            out = out.where(any_)
        else:
            out = out.where(_test(df, column, rule))
    if "order" in params:
        keys = [k.split(".") for k in params["order"].split(",")]
        out = out.orderBy(*[F.col(k[0]).desc_nulls_last() if "desc" in k[1:] else F.col(k[0]).asc_nulls_first() if "nullsfirst" in k[1:] else F.col(k[0]).asc_nulls_last() for k in keys])
    if "offset" in params:
        out = out.offset(int(params["offset"]))
    if "limit" in params:
        out = out.limit(int(params["limit"]))
    return out.select(*[c.strip() for c in params.get("select", "*").split(",")])


def sql_table(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database by JDBC; with a numeric ``key`` between ``low`` and ``high`` it is read in ``parts`` at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def keyed_archive(spark: SparkSession, path: str, key: str, build) -> tuple[DataFrame, bool]:
    """(table, fresh): a stored table as long as its key is the one given, else what ``build()`` gives, stored under that key.

    The key stands in the folder's name, so that a reader never meets a table of another key.
    """
    folder = f"{path.rstrip('/')}/key={key}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.parquet(folder), False
    build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder), True


def snapshot(df: DataFrame, label: str = "snapshot") -> DataFrame:
    """A table read once from a system that changes, for queries that read it twice."""
    return materialise(df, label)
