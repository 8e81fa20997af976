"""Column functions that classify rooms: the current engine's signals and votes, and the older engines' rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import canonical, first_of, lookup

GEO, BLOCK, NEAR, SEEN = K.WEIGHTS


def _scored(label: str, confidence: float) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))


def geometry_score(area_sqft: Column, aspect: Column, compactness: Column) -> Column:
    """struct(label, confidence) from size and shape."""
    cases = [
        ((aspect >= 3.5) & (area_sqft >= 40.0), _scored("Corridor", 0.78)),
        ((compactness < 0.45) & (area_sqft > 80), _scored("Hall", 0.55)),
        *((area_sqft < most, _scored(label, c)) for most, label, c in K.AREA_RULES),
    ]
    return first_of(cases, _scored(*K.OPEN_AREA))


def furniture_score(furniture: Column, hint: Column, confidence: Column) -> Column:
    """struct(label, confidence): the hint, replaced by each furniture type in turn that is more confident."""
    table = {k: v for k, v in K.BLOCK_HINTS.items() if k != "LAUNDRY"}
    rooms, sure = {k: v[0] for k, v in table.items()}, {k: v[1] for k, v in table.items()}

    def better(best: Column, kind: Column) -> Column:
        c = lookup(kind, sure)
        return F.when(c > best["confidence"], F.struct(lookup(kind, rooms).alias("label"), c.alias("confidence"))).otherwise(best)

    start = F.struct(F.coalesce(hint, F.lit("")).alias("label"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))
    return F.aggregate(F.coalesce(furniture, F.array().cast("array<string>")), start, better)


def neighbour_score(candidate: Column, neighbours: Column) -> Column:
    """struct(label, confidence): the candidate, reinforced by neighbours that go with it; empty without any."""
    wanted = first_of(((candidate == k, F.array(*map(F.lit, v))) for k, v in K.NEXT_TO.items()), F.array().cast("array<string>"))
    hosts = first_of(
        ((candidate == t, F.array(*[F.lit(k) for k, v in K.NEXT_TO.items() if t in v])) for t in K.ROOM_TYPES if any(t in v for v in K.NEXT_TO.values())),
        F.array().cast("array<string>"),
    )
    matches = F.size(F.filter(neighbours, lambda n: F.array_contains(wanted, n)))
    strong = F.struct(candidate.alias("label"), F.least(F.lit(0.85), F.lit(0.4) + F.lit(0.15) * matches).alias("confidence"))
    weak = F.struct(candidate.alias("label"), F.lit(0.5).alias("confidence"))
    return F.when(matches > 0, strong).when(F.exists(neighbours, lambda n: F.array_contains(hosts, n)), weak).otherwise(_scored("", 0.0))


def weighted_vote(geo: Column, block: Column, near: Column, seen: Column) -> Column:
    """struct(label, confidence, method) of four (label, confidence) signals: the label with the largest weighted sum, the
    earliest signal's on ties; confidence is that sum by the weights of the signals that speak, at most 1."""
    signals = [(geo, GEO), (block, BLOCK), (near, NEAR), (seen, SEEN)]
    weighed = [F.when((s["label"] != "") & (s["confidence"] > 0), s["confidence"] * w).otherwise(0.0) for s, w in signals]

    def total(k: int) -> Column:
        votes = F.lit(0.0)
        for (s, _), w in zip(signals, weighed):
            votes = votes + F.when((w > 0) & (s["label"] == signals[k][0]["label"]), w).otherwise(0.0)
        return F.when(weighed[k] > 0, votes).otherwise(-1.0)

    totals = [total(k) for k in range(4)]
    top = F.greatest(*totals)
    label = first_of(((t == top, s["label"]) for t, (s, _) in zip(totals, signals)), geo["label"])
    weights = F.lit(GEO)
    for s, w in signals[1:]:
        weights = weights + F.when(s["confidence"] > 0, w).otherwise(0.0)
    raw = F.when(top > 0, top).otherwise(geo["confidence"] * GEO)
    method = F.when((seen["label"] != "") & (seen["confidence"] > 0), "vision+rules").when((block["label"] != "") & (block["confidence"] > 0), "rules+blocks").otherwise("rules")
    return F.struct(label.alias("label"), F.least(F.lit(1.0), raw / weights).alias("confidence"), method.alias("method"))


def with_raster(vote: Column, confirmed: Column) -> Column:
    """A vote with the raster's confirmation: 0.05 more confidence."""
    yes = F.coalesce(confirmed, F.lit(False))
    return F.struct(
        vote["label"].alias("label"),
        F.when(yes, F.least(F.lit(1.0), vote["confidence"] + 0.05)).otherwise(vote["confidence"]).alias("confidence"),
        F.when(yes & (vote["method"] == "rules"), "rules+raster").otherwise(vote["method"]).alias("method"),
    )


def needs_vision(original_label: Column, confidence: Column) -> Column:
    return (F.coalesce(original_label, F.lit("")) == "") & (F.coalesce(confidence, F.lit(0.0)) < K.ASK_VISION_BELOW)


def geometry_label_v1(area_sqft: Column, aspect: Column, door_count: Column) -> Column:
    cases = [
        ((aspect >= 4.0) & (area_sqft >= 40.0), F.lit("Corridor")),
        ((door_count == 0) & (area_sqft < 25), F.lit("Utility")),
        *((area_sqft < most, F.lit(label)) for most, label in K.AREA_RULES_V1),
    ]
    return first_of(cases, F.lit("Open Area"))


def contextual_v1(area_sqft: Column, aspect: Column, door_count: Column, furniture: Column, neighbours: Column, text: Column, vision: Column, vision_confidence: Column) -> Column:
    """struct(label, confidence, method, needs_ai): text, else furniture and area rules, neighbours, and vision where unsure."""
    kinds = F.transform(furniture, F.upper)
    near = F.transform(neighbours, F.upper)

    def has(*names: str) -> Column:
        return F.arrays_overlap(kinds, F.array(*map(F.lit, names)))

    def rule(label: str | Column, confidence: float, method: str) -> Column:
        return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))

    found = first_of(
        [
            (has("STOVE"), rule("Kitchen", 0.93, "rules+furniture")),
            (has("BED"), rule("Bedroom", 0.92, "rules+furniture")),
            (has("WC", "SINK"), rule(F.when(area_sqft < 60, "Toilet").otherwise("Bathroom"), 0.91, "rules+furniture")),
            (has("SOFA", "DINING") & (area_sqft > 140), rule("Hall", 0.83, "rules+furniture")),
            (has("SOFA", "DINING"), rule("Living Room", 0.8, "rules+furniture")),
            (area_sqft < 35, rule("Toilet", 0.76, "rules+area")),
            ((area_sqft > 200) & (door_count >= 2) & (aspect < 3.0), rule("Hall", 0.8, "rules+area")),
        ],
        rule(geometry_label_v1(area_sqft, aspect, door_count), 0.62, "rules"),
    )

    def beside(*names: str) -> Column:
        return F.arrays_overlap(near, F.array(*map(F.lit, names)))

    label, sure = found["label"], found["confidence"]
    sure = F.when((label == "Kitchen") & beside("HALL"), F.least(F.lit(0.95), sure + 0.03)).when(label.isin("Toilet", "Bathroom") & beside("BEDROOM", "HALL"), F.least(F.lit(0.93), sure + 0.03)).otherwise(sure)
    return contextual_choice_v1(label, sure, found["method"], text, vision, vision_confidence)


def contextual_choice_v1(label: Column, sure: Column, method: Column, text: Column, vision: Column, vision_confidence: Column) -> Column:
    """struct(label, confidence, method, needs_ai): text, else vision where the rules are unsure, else what the rules say."""
    unsure = sure < 0.75
    refine = unsure & (F.coalesce(vision, F.lit("")) != "") & (vision_confidence >= 0.72)
    by_text = F.coalesce(text, F.lit("")) != ""
    return F.struct(
        F.when(by_text, text).when(refine, vision).otherwise(label).alias("label"),
        F.when(by_text, 0.95).when(refine, F.least(F.lit(0.9), vision_confidence)).otherwise(sure).alias("confidence"),
        F.when(by_text, "text").when(refine, "vision-refine").otherwise(method).alias("method"),
        F.when(by_text | refine, F.lit(False)).otherwise(unsure).alias("needs_ai"),
    )


def multi_signal_v1(text: Column, vision: Column, vision_confidence: Column, geometry: Column) -> Column:
    """struct(label, confidence, method): the most confident of the signals that speak, the earlier on ties."""
    t, v, g = (F.coalesce(c, F.lit("")) != "" for c in (text, vision, geometry))

    def same(a: Column, b: Column) -> Column:
        return canonical(a) == canonical(b)

    def signal(on: Column, label: Column, confidence: Column, method: Column) -> Column:
        return F.when(on, F.struct(label.alias("label"), confidence.alias("confidence"), method.alias("method")))

    tv, tg, vg = v & same(vision, text), g & same(geometry, text), g & same(vision, geometry)
    signals = F.array(
        signal(t, text, F.when(tv, 0.97).when(tg, 0.95).otherwise(0.92), F.when(tv, "text+vision").when(tg, "text+geometry").otherwise("text")),
        signal(v, vision, F.when(vg, F.least(F.lit(0.92), vision_confidence + 0.10)).otherwise(vision_confidence), F.when(vg, "vision+geometry").otherwise("vision")),
        signal(g, geometry, F.lit(0.60), F.lit("geometry")),
    )
    none = F.struct(F.lit("Unknown").alias("label"), F.lit(0.50).alias("confidence"), F.lit("geometry").alias("method"))
    spoken = F.filter(signals, lambda s: s.isNotNull())
    best = F.aggregate(spoken, F.get(spoken, F.lit(0)), lambda b, s: F.when(s["confidence"] > b["confidence"], s).otherwise(b))
    return F.coalesce(best, none)


def label_v0(area_value: Column, aspect: Column, hall: float = 150, bedroom: tuple[float, float] = (60, 120), toilet: float = 40, corridor: float = 5) -> Column:
    cases = [(area_value > hall, F.lit("Hall")), (area_value.between(*bedroom), F.lit("Bedroom")), (area_value < toilet, F.lit("Toilet")), (aspect > corridor, F.lit("Corridor"))]
    return first_of(cases, F.lit("Unknown"))
