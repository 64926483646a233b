"""Tables of users, articles, drafts and previews: a folder of Parquet, or a database over JDBC where an address names one."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "./warehouse"


def connection(address: str | None) -> dict[str, str] | None:
    """JDBC options of a database's address: postgres in any of its spellings (`postgres://`, `postgresql://`, with a driver's
    name after a plus), where user and password leave the URL and query parameters stay, or a JDBC address as it is. None for
    anything else, which is a folder."""
    if (address or "").startswith("jdbc:"):
        return {"url": address}
    parts = urlsplit(address or "")
    if parts.scheme.split("+")[0] not in ("postgres", "postgresql"):
        return None
    port = f":{parts.port}" if parts.port else ""
    found = {"url": f"jdbc:postgresql://{parts.hostname or 'localhost'}{port}{parts.path}" + (f"?{parts.query}" if parts.query else ""), "driver": "org.postgresql.Driver"}
    own = {"user": parts.username, "password": parts.password}
    return found | {k: unquote(v) for k, v in own.items() if v}


def _folder(address: str | None, name: str) -> str:
    return f"{(address or DEFAULT).rstrip('/')}/{name}"


def bounds(spark: SparkSession, options: dict[str, str], name: str, column: str) -> tuple[int, int] | None:
    """The least and greatest value of a numeric column, asked of the database; None for a table without any."""
    own = '"' + column.replace('"', '""') + '"'  # as Spark names it when it writes
    rows = spark.read.format("jdbc").options(query=f"SELECT min({own}) AS least, max({own}) AS most FROM {name}", **options).load()
    least, most = rows.first()
    return None if least is None else (int(least), int(most))


def read(spark: SparkSession, address: str | None, name: str, by: str | None = None, parts: int | None = None) -> DataFrame:
    """A table of the database or folder. With `by`, a numeric column, a database's table is read by `parts` tasks (the
    session's default parallelism), each a range of the column between its least and greatest value; rows that come beyond
    those, and nulls, fall to the ranges at the ends."""
    options = connection(address)
    if options is None:
        return spark.read.parquet(_folder(address, name))
    if by and (ends := bounds(spark, options, name, by)):
        n = parts or spark.sparkContext.defaultParallelism
        options |= {"partitionColumn": by, "lowerBound": str(ends[0]), "upperBound": str(ends[1] + 1), "numPartitions": str(n)}
    return spark.read.format("jdbc").options(dbtable=name, **options).load()


def write(rows: DataFrame, address: str | None, name: str, mode: str = "append") -> None:
    options = connection(address)
    if options is None:
        rows.write.mode(mode).parquet(_folder(address, name))
    else:
        rows.write.format("jdbc").options(dbtable=name, **options).mode(mode).save()


def append_once(rows: DataFrame, address: str | None, name: str, key: str, parts: int | None = None) -> None:
    """Appends the rows whose key the table does not have, one of each key. A task writes its rows in one transaction, so a
    batch that was broken off leaves whole tasks' rows, and running it again adds what is missing and nothing twice. Two
    writers at one time need a unique key in the table. Of the table only keys near the batch's are read: those between its
    least and greatest. Rows without a key are left out, as nothing tells them apart."""
    spark, options = rows.sparkSession, connection(address)
    fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    ends = fresh.agg(F.min(key), F.max(key)).first()
    if ends[0] is None:
        return
    # a folder that is not there yet has no keys
    if options is None and not _there(spark, _folder(address, name)):
        return write(fresh, address, name)
    near = read(spark, address, name, key if options else None, parts).where(F.col(key).between(*ends)).select(key)
    write(fresh.join(near, key, "left_anti").select(*rows.columns), address, name)


def _there(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.parquet(folder)
    except AnalysisException:
        return False
    return True
