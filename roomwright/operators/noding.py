"""Wall graphs as tables: endpoints, bridges over door gaps, segments cut at each other, snapped edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import cells_along


def endpoints(segments: DataFrame, digits: int = 6) -> DataFrame:
    """drawing_id, x, y: the distinct end points, told apart by rounded coordinates."""
    ends = segments.select("drawing_id", F.explode(F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y")))).alias("p"))
    key = [F.round(F.col("p")[c], digits).alias(f"_{c}") for c in ("x", "y")]
    return ends.groupBy("drawing_id", *key).agg(F.min("p").alias("p")).select("drawing_id", "p.x", "p.y")


def gap_bridges(segments: DataFrame, least_m: float = 0.7, most_m: float = 1.1, metres: Column | float = 1.0, skip_existing: bool = False) -> DataFrame:
    """A segment between any two end points of a drawing whose distance is that of a door opening.

    Points are dealt to square cells as wide as the widest gap; each meets those of its own cell and of the four cells ahead, so
    every pair meets once, by an equi-join. metres: metres per unit, a number or a column of segments.
    skip_existing leaves out pairs that a segment joins already.
    """
    points = endpoints(segments)
    if isinstance(metres, (int, float)):
        points = points.withColumn("_m", F.lit(max(float(metres), 1e-12)))
    else:
        points = points.join(segments.groupBy("drawing_id").agg(F.greatest(F.max(metres), F.lit(1e-12)).alias("_m")), "drawing_id")
    points = points.withColumn("_far", F.lit(most_m) / F.col("_m"))
    points = points.select("*", *[F.floor(F.col(c) / F.col("_far")).alias(f"_c{c}") for c in ("x", "y")])
    ahead = F.array(*[F.struct((F.col("_cx") + i).alias("x"), (F.col("_cy") + j).alias("y")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    left = points.select("drawing_id", F.struct("x", "y").alias("a"), "_m", "_far", F.struct("_cx", "_cy").alias("own"), F.explode(ahead).alias("c"))
    left = left.select("drawing_id", "a", "_m", "_far", (F.struct("c.x", "c.y") == F.struct(F.col("own._cx"), F.col("own._cy"))).alias("_same"), F.col("c.x").alias("_cx"), F.col("c.y").alias("_cy"))
    right = points.select("drawing_id", F.struct("x", "y").alias("b"), "_cx", "_cy")
    gap = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    wide = (gap >= F.lit(least_m) / F.col("_m")) & (gap <= F.col("_far")) & (gap > 0.01)
    found = left.join(right, ["drawing_id", "_cx", "_cy"]).where((~F.col("_same") | (F.col("a") < F.col("b"))) & wide)
    found = found.select("drawing_id", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    found = found.select("drawing_id", F.col("p.x").alias("sx"), F.col("p.y").alias("sy"), F.col("q.x").alias("ex"), F.col("q.y").alias("ey"))
    if skip_existing:
        a, b = F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y"))
        known = segments.select("drawing_id", F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).distinct()
        found = found.withColumn("_a", a).withColumn("_b", b).join(known, ["drawing_id", "_a", "_b"], "left_anti").drop("_a", "_b")
    return found


def with_bridges(segments: DataFrame, **gaps) -> DataFrame:
    return segments.unionByName(gap_bridges(segments, **gaps).withColumn("layer", F.lit("BRIDGE")), allowMissingColumns=True)


def node_edges(segments: DataFrame, digits: int = 9) -> DataFrame:
    """drawing_id, ax, ay, bx, by: segments cut wherever they meet, as distinct undirected edges (a before b).

    A drawing's extent is cut into cells, more of them the more segments it has; only segments that share a cell are compared.
    So a giant drawing spreads over many tasks, and no geometry is ever held as a whole.
    """
    xs, ys = (F.least("sx", "ex"), F.greatest("sx", "ex")), (F.least("sy", "ey"), F.greatest("sy", "ey"))
    s = segments.where((F.col("sx") != F.col("ex")) | (F.col("sy") != F.col("ey"))).select("drawing_id", "sx", "sy", "ex", "ey").distinct()
    box = s.groupBy("drawing_id").agg(F.min(xs[0]).alias("_x"), F.min(ys[0]).alias("_y"), F.greatest(F.max(xs[1]) - F.min(xs[0]), F.max(ys[1]) - F.min(ys[0])).alias("_size"), cells_along(F.count(F.lit(1))).alias("_grid"))
    s = s.join(box, "drawing_id").withColumn("_step", F.greatest(F.col("_size"), F.lit(1e-9)) / F.col("_grid"))

    def cells(span: tuple[Column, Column], origin: str) -> Column:
        return F.sequence(*[F.floor((v + d - F.col(origin)) / F.col("_step")) for v, d in ((span[0], -1e-9), (span[1], 1e-9))])

    placed = s.withColumns({"_xs": cells(xs, "_x"), "_ys": cells(ys, "_y")})
    dealt = placed.withColumn("_cx", F.explode("_xs")).withColumn("_cy", F.explode("_ys"))
    seg = F.struct("sx", "sy", "ex", "ey")
    low = [F.get(c, F.lit(0)) for c in ("_xs", "_ys")]
    a = dealt.select("drawing_id", "_cx", "_cy", seg.alias("a"), low[0].alias("_ax"), low[1].alias("_ay"))
    b = dealt.select("drawing_id", "_cx", "_cy", seg.alias("b"), low[0].alias("_bx"), low[1].alias("_by"))
    # a pair counts in the cell of the larger low corner only, which both have, so that it comes once
    once = (F.col("_cx") == F.greatest("_ax", "_bx")) & (F.col("_cy") == F.greatest("_ay", "_by"))
    pairs = a.join(b, ["drawing_id", "_cx", "_cy"]).where(once & (F.col("a") < F.col("b"))).select("drawing_id", "a", "b")
    met = pairs.select("drawing_id", "a", "b", _meeting(F.col("a"), F.col("b")).alias("p")).where(F.size("p") > 0)
    cuts = met.select("drawing_id", F.explode(F.array("a", "b")).alias("seg"), "p").select("drawing_id", "seg", F.explode("p").alias("q"))
    own = s.select("drawing_id", seg.alias("seg"))
    ends = own.select("drawing_id", "seg", F.explode(F.array(_point(F.col("seg.sx"), F.col("seg.sy")), _point(F.col("seg.ex"), F.col("seg.ey")))).alias("q"))
    x, y = F.round("q.x", digits) + 0.0, F.round("q.y", digits) + 0.0
    place = (F.col("q.x") - F.col("seg.sx")) * (F.col("seg.ex") - F.col("seg.sx")) + (F.col("q.y") - F.col("seg.sy")) * (F.col("seg.ey") - F.col("seg.sy"))
    along = ends.unionByName(cuts).select("drawing_id", "seg", F.struct(F.round(place, digits).alias("t"), x.alias("x"), y.alias("y")).alias("q"))
    lines = along.groupBy("drawing_id", "seg").agg(F.array_sort(F.collect_set("q")).alias("q"))
    steps = F.transform(F.sequence(F.lit(0), F.size("q") - 2), lambda k: F.struct(F.get("q", k).alias("p"), F.get("q", k + 1).alias("r")))
    edges = lines.where(F.size("q") > 1).select("drawing_id", F.explode(steps).alias("e"))
    p, r = (F.struct(F.col(f"e.{n}.x").alias("x"), F.col(f"e.{n}.y").alias("y")) for n in "pr")
    edges = edges.select("drawing_id", F.least(p, r).alias("a"), F.greatest(p, r).alias("b")).where(F.col("a") != F.col("b"))
    # dealt by drawing, as the tracing that follows needs them: one exchange for both
    edges = edges.repartition("drawing_id").distinct()
    return edges.select("drawing_id", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _meeting(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Points where two segments meet: ends of one on the other, else a proper crossing."""

    def on(s: Column, x: Column, y: Column) -> Column:
        dx, dy = s["ex"] - s["sx"], s["ey"] - s["sy"]
        size = F.hypot(dx, dy)
        along = (x - s["sx"]) * dx + (y - s["sy"]) * dy
        return (F.abs(dx * (y - s["sy"]) - dy * (x - s["sx"])) <= size * eps) & (along >= -eps * size) & (along <= size * (size + eps))

    ends = F.array(*[F.when(on(s, t[f"{e}x"], t[f"{e}y"]), _point(t[f"{e}x"], t[f"{e}y"])) for s, t in ((a, b), (b, a)) for e in "se"])
    touching = F.filter(ends, lambda p: p.isNotNull())
    dx, dy, fx, fy = a["ex"] - a["sx"], a["ey"] - a["sy"], b["ex"] - b["sx"], b["ey"] - b["sy"]
    cross = F.nullif(dx * fy - dy * fx, F.lit(0.0))
    t = ((b["sx"] - a["sx"]) * fy - (b["sy"] - a["sy"]) * fx) / cross
    u = ((b["sx"] - a["sx"]) * dy - (b["sy"] - a["sy"]) * dx) / cross
    proper = F.when((t > 0) & (t < 1) & (u > 0) & (u < 1), F.array(_point(a["sx"] + t * dx, a["sy"] + t * dy)))
    return F.when(F.size(touching) > 0, touching).otherwise(F.coalesce(proper, F.array().cast("array<struct<x:double,y:double>>")))


def snapped_edges(edges: DataFrame, tolerance: float = 0.001, least: float = 0.005) -> DataFrame:
    """Edges with both ends on a grid, distinct regardless of direction, of a minimal length; `vertical` tells those that rise
    more than they run."""

    def snap(c: str) -> Column:
        return F.rint(F.col(c) / tolerance) * tolerance

    a, b = _point(snap("ax"), snap("ay")), _point(snap("bx"), snap("by"))
    rows = edges.select("drawing_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    rows = rows.select("drawing_id", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return rows.where(F.hypot(dx, dy) >= least).withColumn("vertical", F.abs(dx) < F.abs(dy))


def graph_edges(segments: DataFrame, digits: int | None = None) -> DataFrame:
    """Distinct undirected edges between segment ends, uncut; rounded to some digits for the cycle search."""

    def end(x: str, y: str) -> Column:
        return _point(*(F.col(c) if digits is None else F.round(c, digits) for c in (x, y)))

    rows = segments.select("drawing_id", F.least(end("sx", "sy"), end("ex", "ey")).alias("a"), F.greatest(end("sx", "sy"), end("ex", "ey")).alias("b")).where(F.col("a") != F.col("b")).distinct()
    return rows.select("drawing_id", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
