"""Geometry on planar longitude and latitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(vertices: DataFrame) -> DataFrame:
    """Bounding box of each feature of (feature, lng, lat)."""
    return vertices.groupBy("feature").agg(F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"))


def edges(vertices: DataFrame) -> DataFrame:
    """(feature, x1, y1, x2, y2) of rings given as (feature, ring, i, lng, lat): each vertex and the one before it, the first after the last."""
    from pyspark.sql import Window

    own = Window.partitionBy("feature", "ring").orderBy("i")
    last = Window.partitionBy("feature", "ring").orderBy(F.desc("i"))
    return vertices.select("feature", "ring", "i", F.col("lng").alias("x1"), F.col("lat").alias("y1"), F.coalesce(F.lag("lng").over(own), F.first("lng").over(last)).alias("x2"), F.coalesce(F.lag("lat").over(own), F.first("lat").over(last)).alias("y2"))


def cell(lng: Column, lat: Column, size: float) -> Column:
    return F.struct(F.floor(lng / size).alias("cx"), F.floor(lat / size).alias("cy"))


def in_boxes(points: DataFrame, boxes: DataFrame, size: float = 10.0) -> DataFrame:
    """Points with each feature whose box holds them, bounds included: an equi-join on grid cells, not a nested loop."""
    cells = boxes.withColumn("cx", F.explode(F.sequence(F.floor(F.col("west") / size), F.floor(F.col("east") / size)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("south") / size), F.floor(F.col("north") / size))))
    near = points.withColumn("cx", F.floor(F.col("lng") / size)).withColumn("cy", F.floor(F.col("lat") / size)).join(cells, ["cx", "cy"])
    return near.where("lng between west and east and lat between south and north").drop("cx", "cy", "west", "south", "east", "north")


def in_polygons(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, feature): the first feature that holds each point by the even-odd rule over all its rings, so holes are outside."""
    near = in_boxes(points, bounds(vertices)).join(edges(vertices), "feature")
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("lng") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))
    inside = near.groupBy("id", "feature").agg((F.count_if(F.coalesce(crosses, F.lit(False))) % 2 == 1).alias("inside")).where("inside")
    return inside.groupBy("id").agg(F.min("feature").alias("feature"))


def ring_centres(vertices: DataFrame) -> DataFrame:
    """(feature, ring, area, lng, lat): the largest ring of three vertices or more, first of equals, and the mean of its vertices, the closing one included."""
    sums = edges(vertices).groupBy("feature", "ring").agg(F.count("*").alias("n"), F.abs(F.sum(F.col("x2") * F.col("y1") - F.col("x1") * F.col("y2")) / 2).alias("area"), F.avg("x1").alias("lng"), F.avg("y1").alias("lat"))
    best = sums.where("n >= 3").groupBy("feature").agg(F.max_by(F.struct("ring", "area", "lng", "lat"), F.struct("area", -F.col("ring"))).alias("r"))
    return best.select("feature", "r.*")
