"""Column functions on names and labels: keyword lookups in a fixed order, normalisers, block types."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once per row; as an operand of many branches it would be computed again in each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether the text contains one of the words."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def first_of(cases: Iterable[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return default if out is None else out.otherwise(default)


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Exact match in a small table; null if there is none."""
    return first_of(((key == k, F.lit(v)) for k, v in table.items()), F.lit(None))


def first_contained(text: Column, table: Mapping[str, object]) -> Column:
    """The value of the first key, in the table's order, that the text contains; null if there is none."""
    return first_of(((F.contains(text, F.lit(k)), F.lit(v)) for k, v in table.items()), F.lit(None))


def title_case(text: Column) -> Column:
    """Upper case after anything that is no letter, lower case after a letter."""
    marked = F.regexp_replace(F.lower(text), r"(?<!\p{L})(\p{L})", "\u0001$1")
    parts = F.split(marked, "\u0001")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))), "")


def layer_name(layer: Column) -> Column:
    """Upper case without surrounding blanks; missing or empty names are layer 0."""
    return F.upper(F.trim(F.coalesce(F.nullif(layer, F.lit("")), F.lit("0"))))


def is_door_layer(layer: Column) -> Column:
    return any_of(F.upper(layer), K.DOOR_LAYER_HINTS)


def block_type(name: Column) -> Column:
    """DOOR if the name contains any door word, else the type of the first furniture word, else GENERIC."""
    upper = F.upper(name)
    return F.when(any_of(upper, K.DOOR_BLOCKS), "DOOR").otherwise(F.coalesce(first_contained(upper, K.FURNITURE), F.lit("GENERIC")))


def block_type_v1(name: Column) -> Column:
    return F.coalesce(first_contained(F.upper(name), K.FURNITURE_V1), F.lit("GENERIC"))


def block_hint(name: Column) -> Column:
    """struct(type, room, confidence) of the most confident furniture word in the name, the earlier on ties."""
    ranked = sorted(K.BLOCK_HINTS.items(), key=lambda kv: -kv[1][1])
    upper = F.upper(name)

    def as_struct(word: str, room: str, confidence: float) -> Column:
        return F.struct(F.lit(word).alias("type"), F.lit(room).alias("room"), F.lit(confidence).alias("confidence"))

    return once(upper, lambda t: first_of(((F.contains(t, F.lit(w)), as_struct(w, room, c)) for w, (room, c) in ranked), as_struct("GENERIC", "", 0.0)))


def room_label(raw: Column) -> Column:
    """Room type of a label text: exact, else first contained key, else a room type that contains or is contained in the title
    form (the alphabetically first), else the title form."""

    def of_title(title: Column) -> Column:
        return first_of(((F.contains(F.lit(t), title) | F.contains(title, F.lit(t)), F.lit(t)) for t in sorted(K.ROOM_TYPES)), title)

    known = once(F.trim(F.upper(raw)), lambda upper: F.coalesce(lookup(upper, K.LABELS), first_contained(upper, K.LABELS)))
    return F.coalesce(known, once(F.trim(title_case(raw)), of_title))


def ocr_label(raw: Column) -> Column:
    """Room type of a recognised word, or null."""
    text = F.trim(F.regexp_replace(F.upper(raw), "[^A-Za-z ]+", " "))
    text = F.nullif(F.regexp_replace(text, r"\s+", " "), F.lit(""))
    return once(text, lambda t: F.coalesce(lookup(t, K.OCR_LABELS), first_contained(t, K.OCR_LABELS)))


def short_label(raw: Column) -> Column:
    """Name of an abbreviation, also without trailing digits, or null."""
    key = F.regexp_replace(F.trim(F.regexp_replace(F.upper(raw), "[^A-Z0-9. ]", "")), r"\s+", " ")
    bare = F.trim(F.regexp_replace(key, r"\s*\d+$", ""))
    return F.coalesce(*(once(k, lambda t: lookup(t, K.SHORT_LABELS)) for k in (key, bare)))


def offline_label(raw: Column) -> Column:
    """The bulk normaliser without a model: abbreviation or title form."""
    return F.coalesce(short_label(raw), title_case(raw))


def canonical(label: Column) -> Column:
    return F.trim(F.upper(F.coalesce(label, F.lit(""))))


def plain_label(label: Column) -> Column:
    """Lower case with single blanks, for comparing label sets."""
    return F.regexp_replace(F.lower(F.trim(label)), r"\s+", " ")


def is_quota_error(message: Column) -> Column:
    return any_of(message, K.QUOTA_SIGNS) | any_of(F.lower(message), [s.lower() for s in K.QUOTA_SIGNS])
