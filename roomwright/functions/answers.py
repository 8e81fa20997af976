"""Column functions on answers of vision models: prompts, and reading JSON out of prose and code fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

ANSWER = "struct<room_index:int,room_type:string,confidence:double>"


def without_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, "(?i)```(?:json)?", "")), "^`+|`+$", ""))


def answer_list(text: Column) -> Column:
    """The array of answers between the first [ and the last ]; empty if that is no JSON."""
    body = without_fences(text)
    found = F.nullif(F.regexp_extract(body, r"(?s)\[.*\]", 0), F.lit(""))
    return F.coalesce(F.from_json(F.coalesce(found, body), f"array<{ANSWER}>"), F.array().cast(f"array<{ANSWER}>"))


def answer_object(text: Column) -> Column:
    """struct(room_type, confidence) between the first { and the last }; null unless the type is known. A missing or zero
    confidence is 0.5."""
    body = without_fences(text)
    found = F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))
    read = F.from_json(F.coalesce(found, body), ANSWER)
    sure = F.coalesce(F.nullif(read["confidence"], F.lit(0.0)), F.lit(0.5))
    return F.when(read["room_type"].isin(*K.ROOM_TYPES), F.struct(read["room_type"].alias("room_type"), sure.alias("confidence")))


def answer_list_v1(text: Column) -> Column:
    """Like answer_list, but everything from the first [ must be JSON."""
    body = F.regexp_replace(F.trim(F.regexp_replace(text, r"```(?:json)?\s*", "")), "`+$", "")
    whole = F.from_json(body, f"array<{ANSWER}>")
    rest = F.from_json(F.nullif(F.regexp_extract(body, r"(?s)\[.*", 0), F.lit("")), f"array<{ANSWER}>")
    return F.coalesce(F.when(F.ltrim(body).startswith("["), whole), rest, F.array().cast(f"array<{ANSWER}>"))


def _listed(items: Column, default: str) -> Column:
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.array_join(items, ", ")).otherwise(default)


def room_line(number: Column, area_sqft: Column, furniture: Column, adjacent: Column, guess: Column) -> Column:
    """One room's line in a question about a whole floor."""
    return F.concat(
        F.lit("  Room "), number.cast("string"), F.lit(": area="), F.format_string("%.0f", area_sqft), F.lit("sqft  furniture="), _listed(furniture, "none"),
        F.lit("  adjacent=["), _listed(adjacent, "unknown"), F.lit("]  current_guess="), F.coalesce(guess, F.lit("?")),
    )


def room_question(area_sqft: Column, furniture: Column, adjacent: Column) -> Column:
    """A question about one room's picture."""
    types = ", ".join(K.ROOM_TYPES)
    return F.concat(
        F.lit("The picture shows one room of a floor plan.\nArea: "), F.format_string("%.0f", area_sqft), F.lit(" sqft\nFurniture: "), _listed(furniture, "none"), F.lit("\nAdjacent rooms: "), _listed(adjacent, "unknown"),
        F.lit(f'\nAnswer with one of these types: {types}\nReturn JSON only: {{"room_type": "Bedroom", "confidence": 0.92}}'),
    )


def floor_question(rooms: Column, count: Column) -> Column:
    """A question about a floor's picture; rooms: the lines of its rooms, joined."""
    types = ", ".join(K.ROOM_TYPES)
    return F.concat(
        F.lit("The picture shows a floor plan with "), count.cast("string"), F.lit(" detected rooms:\n"), rooms,
        F.lit(f'\nConfirm or correct their types; use only: {types}\nReturn a JSON array with one entry per room, in this order: [{{"room_index": 1, "room_type": "Bedroom", "confidence": 0.93}}]'),
    )
