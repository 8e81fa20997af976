"""Layers: counts, which layers hold walls, and the wall segments of a drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.shapes import length
from ..functions.text import any_of, layer_name


def layer_counts(entities: DataFrame, order: Column | None = None) -> DataFrame:
    """drawing_id, layer, n, first_seen (the least order value, or the name)."""
    rows = entities.select("drawing_id", layer_name(F.col("layer")).alias("layer"), (F.lit(0) if order is None else order).alias("_o"))
    return rows.groupBy("drawing_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("first_seen"))


def wall_layers(counts: DataFrame) -> DataFrame:
    """drawing_id, layer, rank: layers with a wall word by count; without any, the five busiest less the noise layers (which
    are dropped after the cut). Equal counts: the layer seen first, then by name."""
    drawing = W.partitionBy("drawing_id")
    order = [F.desc("n"), "first_seen", "layer"]
    hinted = counts.withColumn("_wall", any_of(F.col("layer"), K.WALL_LAYER_HINTS)).withColumn("_any", F.max("_wall").over(drawing))
    ranked = hinted.withColumn("_all", F.row_number().over(drawing.orderBy(*order)))
    kept = ranked.where(F.when(F.col("_any"), F.col("_wall")).otherwise((F.col("_all") <= 5) & ~any_of(F.col("layer"), K.NOISE_LAYERS)))
    return kept.select("drawing_id", "layer", F.row_number().over(drawing.orderBy(*order)).cast("long").alias("rank"))


def wall_layers_v1(counts: DataFrame) -> DataFrame:
    """As wall_layers, but hinted layers by name, and the five busiest without a noise filter."""
    drawing = W.partitionBy("drawing_id")
    busiest = [F.desc("n"), "first_seen", "layer"]
    hinted = counts.withColumn("_wall", any_of(F.col("layer"), K.WALL_LAYER_HINTS_V1)).withColumn("_any", F.max("_wall").over(drawing))
    ranked = hinted.withColumn("_all", F.row_number().over(drawing.orderBy(*busiest)))
    kept = ranked.where(F.when(F.col("_any"), F.col("_wall")).otherwise(F.col("_all") <= 5))
    order = [F.when(F.col("_any"), F.col("layer")), *busiest]
    return kept.select("drawing_id", "layer", F.row_number().over(drawing.orderBy(*order)).cast("long").alias("rank"))


def wall_segments(segments: DataFrame, walls: DataFrame | None = None) -> DataFrame:
    """Segments of wall layers. Without wall layers: everything of a drawing with one layer, else all but noise layers.
    walls: (drawing_id, layer)."""
    upper = F.upper(F.coalesce("layer", F.lit("")))
    noise = any_of(F.col("_layer"), K.GRAPH_NOISE)
    lists = None if walls is None else walls.groupBy("drawing_id").agg(F.collect_set(F.upper("layer")).alias("_walls"))
    one = segments.groupBy("drawing_id").agg((F.min(upper) == F.max(upper)).alias("_single"))
    rows = segments.withColumn("_layer", upper).join(one, "drawing_id", "left")
    rows = rows.withColumn("_walls", F.lit(None).cast("array<string>")) if lists is None else rows.join(lists, "drawing_id", "left")
    listed = ~noise & (any_of(F.col("_layer"), K.GRAPH_WALL_HINTS) | F.exists("_walls", lambda w: F.contains(F.col("_layer"), w)))
    return rows.where(F.when(F.col("_walls").isNull(), F.col("_single") | ~noise).otherwise(listed)).drop("_layer", "_walls", "_single")


def wall_segments_v1(segments: DataFrame, walls: DataFrame | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Segments without a dropped word whose layer contains an allowed layer; a drawing with one layer keeps them all."""
    upper = F.upper(F.coalesce("layer", F.lit("")))
    one = segments.groupBy("drawing_id").agg((F.min(upper) == F.max(upper)).alias("_single"))
    rows = segments.withColumn("_layer", upper).join(one, "drawing_id", "left")
    if walls is None:
        return rows.where(~any_of(F.col("_layer"), drop)).drop("_layer", "_single")
    lists = walls.groupBy("drawing_id").agg(F.collect_set(F.upper("layer")).alias("_walls"))
    rows = rows.join(lists, "drawing_id", "left")
    kept = F.col("_single") | F.col("_walls").isNull() | F.exists("_walls", lambda w: F.contains(F.col("_layer"), w))
    return rows.where(~any_of(F.col("_layer"), drop) & kept).drop("_layer", "_walls", "_single")


def at_least(segments: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """Segments of a minimal length: dust (1e-6, strict) for the current engine, 0.005 for the older one."""
    size = length(*map(F.col, ("sx", "sy", "ex", "ey")))
    return segments.where(size > least if strict else size >= least)
