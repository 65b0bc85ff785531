"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from graphloom.session import shared_folder
from graphloom.sources.tables import SQL, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and times as seconds, so that both engines' rows compare by value."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_timestamp(c.cast("timestamp"))
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, select: str | None = None, *parts: str, recursive: bool = False):
    """Register a function of the model under ``name``.

    ``select`` is the oracle's last statement, ``parts`` further common table
    expressions that it needs besides the model's.
    """

    def register(make: Callable[[Model], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            if spark.sparkContext.getCheckpointDir() is None:
                spark.sparkContext.setCheckpointDir(shared_folder(spark))
            return plain(make(Model(spark, sf_dir)))

        run.__name__ = run.__qualname__ = name
        run.__doc__ = make.__doc__
        QUERIES[name] = run
        if select is not None:
            ORACLE_SQL[name] = f"with {'recursive ' if recursive else ''}{', '.join([SQL.strip(), *parts])} {select}"
        return make

    return register
