"""Writers of results, states and error lists."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, key: str = "file_key", by: Sequence[str] = (), batch: str | None = None) -> None:
    """Parquet parts, sorted by key within each; a named batch has a folder of its own, which a retry replaces."""
    out = df.sortWithinPartitions(key).write.partitionBy(*by)
    if batch is None:
        out.mode("append").parquet(path)
    else:
        out.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def spread_matrix(df: DataFrame, column: str, n: int) -> DataFrame:
    """A column of lists as n columns <name>_0 to <name>_<n-1>, for readers without nested lists."""
    return df.select("*", *[F.get(F.col(column), F.lit(i)).alias(f"{column}_{i}") for i in range(n)]).drop(column)


def restore_matrix(df: DataFrame, column: str) -> DataFrame:
    """The inverse of spread_matrix, by number and not by name; null if any part is."""
    parts = sorted((c for c in df.columns if c.startswith(f"{column}_") and c[len(column) + 1 :].isdigit()), key=lambda c: int(c[len(column) + 1 :]))
    whole = F.array(*[F.col(c) for c in parts])
    missing = F.lit(False)
    for c in parts:
        missing = missing | F.col(c).isNull()
    return df.withColumn(column, F.when(~missing, whole)).drop(*parts)


def param_hash(params: dict) -> str:
    """Name of a set of parameters; functions count by their names."""
    plain = {k: getattr(v, "__name__", v) if callable(v) else v for k, v in params.items()}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a table that are whole, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [str(f.getPath().getName()) for f in fs.listStatus(root)]
    whole = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
    return sorted(int(name[8:]) for name in found if name.startswith("version=") and name[8:].isdigit() and whole(name))


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a table that upsert_parquet writes, or None."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def upsert_parquet(spark: SparkSession, new: DataFrame, path: str, key: Sequence[str]) -> None:
    """Replaces rows of equal key and adds the others, by writing the next version of the table beside the others.

    A version counts once its writer has marked it as whole, so a reader finds one at any time, and a writer that
    is cut off leaves the one before. The two newest versions stay. One writer at a time.
    """
    from tidewater.operators.relational import upsert

    found = _versions(spark, path)
    if found:
        new = upsert(spark.read.parquet(f"{path}/version={found[-1]}"), new, key)
    new.write.mode("overwrite").parquet(f"{path}/version={found[-1] + 1 if found else 0}")
    for old in found[:-1]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def upsert_sql(table: str, staged: str, columns: Sequence[str], key: Sequence[str]) -> str:
    """The statement that moves staged rows into a table: rows of equal key are replaced, others added."""
    rest = [c for c in columns if c not in key]
    names = ", ".join(columns)
    then = "UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in rest) if rest else "NOTHING"
    return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staged} WHERE true ON CONFLICT ({', '.join(key)}) DO {then}"


def jdbc_upsert(url: str, table: str, key: Sequence[str], options: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch, or for one table: rows go to a staging table, and one statement moves them.

    Moving the same rows again changes nothing, so a batch may be repeated after a restart. Of several rows of a
    key in a batch an arbitrary one stays.
    """

    def write(batch: DataFrame, number: int) -> None:
        staged = f"{table}_staged"
        batch.dropDuplicates(list(key)).write.mode("overwrite").options(**(options or {})).option("url", url).option("dbtable", staged).format("jdbc").save()
        properties = batch.sparkSession._jvm.java.util.Properties()
        for k, v in (options or {}).items():
            properties.setProperty(k, v)
        connection = batch.sparkSession._jvm.java.sql.DriverManager.getConnection(url, properties)
        try:
            connection.createStatement().executeUpdate(upsert_sql(table, staged, batch.columns, key))
        finally:
            connection.close()

    return write


def read_results_json(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """Results of a grid search or a run, as write_json leaves them; the best first if a column is named."""
    rows = spark.read.json(path)
    return rows.orderBy(F.desc(by)) if by else rows
