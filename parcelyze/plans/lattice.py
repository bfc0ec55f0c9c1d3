"""A parcel lattice derived from the table ``part``: whole micro-degrees, with planted defects.

Slivers (%13), eastward overlaps of 3 micro-degrees (%7), gaps of 2 (%11), zero areas (%97), clockwise rings (%17), and no
layer on odd rows. Integer coordinates keep every predicate exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import bounds, polygon_area

PARCELS_SQL = """
l AS (SELECT p_partkey AS parcel_id, p_partkey % 50 AS c, CAST(floor(p_partkey / 50.0) AS BIGINT) AS r FROM part),
parcels AS (
  SELECT parcel_id, c, r, CASE WHEN r % 2 = 0 THEN 'A' END AS layer, 51000000 + c * 1000 AS x0, 35000000 + r * 1000 AS y0,
    51000000 + c * 1000 + CASE WHEN parcel_id % 13 = 0 THEN 2 WHEN parcel_id % 7 = 0 THEN 1003 WHEN parcel_id % 11 = 0 THEN 998 ELSE 1000 END AS x1,
    35000000 + r * 1000 + CASE WHEN parcel_id % 97 = 0 THEN 0 ELSE 1000 END AS y1,
    CASE WHEN parcel_id % 17 = 0 THEN 'cw' ELSE 'ccw' END AS winding
  FROM l)"""


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parcel_id, c, r, layer, x0, y0, x1, y1, winding), coordinates in micro-degrees."""
    # One small file, but each row stands for a geometry: spread it.
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("parcel_id")).repartition(tasks, "parcel_id")
    p = p.withColumn("c", F.col("parcel_id") % 50).withColumn("r", F.floor(F.col("parcel_id") / 50.0))
    width = F.when(F.col("parcel_id") % 13 == 0, 2).when(F.col("parcel_id") % 7 == 0, 1003).when(F.col("parcel_id") % 11 == 0, 998).otherwise(1000)
    p = p.withColumn("layer", F.when(F.col("r") % 2 == 0, "A")).withColumn("x0", 51000000 + F.col("c") * 1000).withColumn("y0", 35000000 + F.col("r") * 1000)
    p = p.withColumn("x1", F.col("x0") + width).withColumn("y1", F.col("y0") + F.when(F.col("parcel_id") % 97 == 0, 0).otherwise(1000))
    return p.withColumn("winding", F.when(F.col("parcel_id") % 17 == 0, "cw").otherwise("ccw"))


def _ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[F.array(x / 1e6, y / 1e6) for x, y in corners])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice as polygon components: (feature_index, layer, rings, area_m2, minx, miny, maxx, maxy)."""
    p = parcels(spark, sf_dir)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    ring = _ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))
    rings = F.array(F.when(F.col("winding") == "cw", F.reverse(ring)).otherwise(ring))
    p = p.select(F.col("parcel_id").alias("feature_index"), "layer", rings.alias("rings"))
    return p.withColumn("area_m2", polygon_area(F.col("rings"))).withColumn("_b", bounds(F.get("rings", F.lit(0)))).select("*", "_b.*").drop("_b")


def features_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice as features for the dry run: (feature_index, feature), feature as GeoJSON text."""
    p = features(spark, sf_dir)
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("feature_index").alias("id"), F.col("layer").alias("cadLayer"), F.struct(F.col("feature_index").alias("parcel")).alias("properties"), geometry.alias("geometry"))
    return p.select("feature_index", F.to_json(feature).alias("feature"))
