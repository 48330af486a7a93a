"""Reading nested records: map features, candidate files and saved state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOJSON = "type string, features array<struct<properties:struct<ADMIN:string,SUBREGION:string,CONTINENT:string>,geometry:struct<type:string,coordinates:string>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, admin, sub, cont, polys) of GeoJSON files; polygons and multipolygons become lists of polygons of rings of [lng, lat]."""
    raw = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
    each = raw.select(F.posexplode(F.coalesce("features", F.array())).alias("ordinal", "f"))
    rings, shape = "array<array<array<double>>>", F.col("f.geometry.coordinates")
    polys = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(shape, rings))).when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(shape, f"array<{rings}>"))
    return each.select("ordinal", F.col("f.properties.ADMIN").alias("admin"), F.col("f.properties.SUBREGION").alias("sub"), F.col("f.properties.CONTINENT").alias("cont"), polys.alias("polys"))


def vertices(found: DataFrame) -> DataFrame:
    """(feature, ring, i, lng, lat) of features."""
    rings = found.select(F.col("ordinal").alias("feature"), F.posexplode(F.flatten("polys")).alias("ring", "points"))
    return rings.select("feature", "ring", F.posexplode("points").alias("i", "p")).select("feature", "ring", "i", F.get("p", F.lit(0)).alias("lng"), F.get("p", F.lit(1)).alias("lat"))


def write_payloads(rows: DataFrame, path: str) -> None:
    """One JSON document a row, gzipped."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)
