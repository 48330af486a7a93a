"""Lookups with fallbacks, name resolution, preferences, greedy choices and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.scalars import first_of

#: Rows of a dimension that is broadcast without being counted first by its caller.
DIMENSION_ROWS = 10_000


def dimension(spark, rows: list[tuple], columns: str) -> DataFrame:
    """A small table of fixed rows, to be broadcast; its size is checked."""
    if len(rows) > DIMENSION_ROWS:
        raise ValueError(f"{len(rows)} rows are no dimension")
    return F.broadcast(spark.createDataFrame(rows, columns))


def resolve_theme(places: DataFrame, themes: DataFrame, palettes: DataFrame, by_country: DataFrame, by_subregion: DataFrame, by_continent: DataFrame, palette: str, landmark: str) -> DataFrame:
    """Adds palette, sky, sun, accent, motif, label, landmark by chains of fallbacks.

    places has country, subregion, continent.  A palette that does not exist is the default one.
    """
    found = places.join(themes.withColumnsRenamed({"palette": "t_palette", "motif": "t_motif", "label": "t_label"}), "country", "left")
    found = found.join(by_continent.withColumnRenamed("palette", "c_palette"), "continent", "left")
    found = found.withColumn("wanted", F.coalesce(first_of(F.col("t_palette"), F.col("c_palette")), F.lit(palette)))
    found = found.join(palettes.withColumnRenamed("palette", "wanted").withColumn("exists", F.lit(True)), "wanted", "left")
    default = palettes.where(F.col("palette") == palette).select(*(F.col(c).alias(f"d_{c}") for c in ("sky", "sun", "accent")))
    found = found.join(F.broadcast(default.limit(1)), how="left")
    found = found.join(by_country.withColumnRenamed("landmark", "l1"), "country", "left").join(by_subregion.withColumnRenamed("landmark", "l2"), "subregion", "left")
    return found.select(*places.columns, F.when(F.col("exists"), F.col("wanted")).otherwise(palette).alias("palette"), *(F.coalesce(c, f"d_{c}").alias(c) for c in ("sky", "sun", "accent")), F.coalesce(first_of(F.col("t_motif")), F.lit(landmark)).alias("motif"), F.coalesce(first_of(F.col("t_label")), F.concat(F.lit("Into "), F.col("country"))).alias("label"), F.coalesce(first_of(F.col("l1"), F.col("l2")), F.lit(landmark)).alias("landmark"))


def name_index(names: DataFrame) -> DataFrame:
    """(key, name, ordinal) of an index in which the last of equal names wins and the first gives the place; blank names are left out."""
    kept = names.where(F.coalesce("name", F.lit("")) != "").withColumn("key", F.lower("name"))
    return kept.groupBy("key").agg(F.max_by("name", "ordinal").alias("name"), F.min("ordinal").alias("ordinal"))


def resolve_names(queries: DataFrame, index: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds name: the entry that equals the query, else the first that begins with it, else the first that holds it.

    The query is trimmed, lower-cased and rewritten by aliases first.  The index is
    broadcast by its caller where it is small; queries are distinct before the
    inequality join, so its cost is theirs and not that of the rows.
    """
    asked = queries.select("query").distinct().withColumn("q", F.lower(F.trim("query"))).where("q <> ''")
    asked = asked.join(aliases, F.col("q") == F.col("alias"), "left").withColumn("q", F.coalesce("target", "q")).select("query", "q")
    rank = F.when(F.col("key") == F.col("q"), 0).when(F.startswith("key", "q"), 1).otherwise(2)
    found = asked.join(index, F.contains("key", "q")).groupBy("query").agg(F.min_by("name", F.struct(rank, "ordinal")).alias("name"))
    return queries.join(found, "query", "left")


def first_by(df: DataFrame, keys: list[str], order: list, n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; a limit within groups prunes rows before they are shuffled."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def neighbours(keys: DataFrame, key: str) -> DataFrame:
    """Distinct keys with the keys before and after each.

    Keys are sorted in ranges; a window gives the neighbours within a range, and the
    few rows at the edges of ranges find theirs among the ranges' least and greatest
    keys.
    """
    ranged = keys.distinct().repartitionByRange(key).withColumn("_range", F.spark_partition_id())
    inner = Window.partitionBy("_range").orderBy(key)
    placed = ranged.select(key, "_range", F.lag(key).over(inner).alias("before"), F.lead(key).over(inner).alias("after"))
    edges = placed.groupBy("_range").agg(F.min(key).alias("least"), F.max(key).alias("greatest"))
    across = Window.orderBy("_range")  # a row for each range
    edges = edges.select(F.lag("greatest").over(across).alias("_before"), F.lead("least").over(across).alias("_after"), "_range")
    joined = placed.join(F.broadcast(edges), "_range")
    return joined.select(key, F.coalesce("before", "_before").alias("before"), F.coalesce("after", "_after").alias("after"))


def greedy_distinct(groups: DataFrame) -> DataFrame:
    """(group, picks): for each of the group's queries in order, the first candidate that none before took.

    groups has group and queries, an array of arrays of ids in order; a fold over
    one row, since each choice depends on all before it.
    """
    def step(taken: Column, options: Column) -> Column:
        return F.concat(taken, F.array(F.get(F.filter(options, lambda x: ~F.coalesce(F.array_contains(taken, x), F.lit(False))), F.lit(0))))

    return groups.select("group", F.aggregate("queries", F.array().cast("array<bigint>"), step).alias("picks"))
