"""Versioned tables: overwrite by key, and read of what an import has left.

A version is a folder of its own; the newest complete one counts (Spark's committer marks it), so readers never see half a write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _versions(spark: SparkSession, path: str) -> list[int]:
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit() and done(n))


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table, or None."""
    have = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={have[-1]}") if have else None


def upsert(rows: DataFrame, path: str, key: list[str], at: str, keep: int = 2) -> int:
    """Writes a new version in which ``rows`` stand in for old ones of their key; returns its number.

    Of several new rows of a key the one with the greatest ``at`` counts. The last ``keep`` versions stay.
    """
    spark = rows.sparkSession
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), at).alias("_row")).select("_row.*")
    old = latest(spark, path)
    whole = newest if old is None else old.join(newest.select(*key), key, "left_anti").unionByName(newest)
    have = _versions(spark, path)
    number = (have[-1] if have else 0) + 1
    whole.write.mode("overwrite").parquet(f"{path}/version={number}")
    for n in have[: max(0, len(have) + 1 - keep)]:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return number


class SourceExpired(LookupError):
    """What was imported is not there any more: the drawing has to be read again."""


def cached_features(spark: SparkSession, path: str) -> DataFrame:
    """The normalised features that an import of a drawing has left; raises SourceExpired if they are gone."""
    found = latest(spark, path)
    if found is None:
        raise SourceExpired(path)
    return found


def cache_features(features: DataFrame, path: str) -> DataFrame:
    """Writes the normalised features of a drawing as a new version and reads them back; a drawing without any is an error."""
    spark = features.sparkSession
    if features.first() is None:
        raise ValueError("the drawing contains no features")
    number = max([0, *_versions(spark, path)]) + 1
    features.write.mode("overwrite").parquet(f"{path}/version={number}")
    return cached_features(spark, path)
