"""DuckDB SQL pieces made from the fixed tables: the oracle's form of the keyword lookups and rules."""

from __future__ import annotations

from .. import constants as K


def lit(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)


def case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def contains_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col},'{w}')" for w in words) + ")"


def exact(col: str, table) -> str:
    return case(((f"{col}={lit(k)}", lit(v)) for k, v in table.items()), "NULL")


def first_contained(col: str, table) -> str:
    return case(((f"contains({col},'{k}')", lit(v)) for k, v in table.items()), "NULL")


def title(col: str) -> str:
    upper = f"i=1 OR NOT regexp_matches(substr({col},i-1,1),'[A-Za-z]')"
    return f"array_to_string(list_transform(range(1,length({col})+1), lambda i: CASE WHEN {upper} THEN upper(substr({col},i,1)) ELSE lower(substr({col},i,1)) END),'')"


def room_label(col: str) -> str:
    up, ti = f"trim(upper({col}))", f"trim({title(col)})"
    types = case(((f"contains('{t}',{ti}) OR contains({ti},'{t}')", lit(t)) for t in sorted(K.ROOM_TYPES)), ti)
    return f"coalesce({exact(up, K.LABELS)},{first_contained(up, K.LABELS)},{types})"


def ocr_label(col: str) -> str:
    text = f"nullif(regexp_replace(trim(regexp_replace(upper({col}),'[^A-Za-z ]+',' ','g')),'\\s+',' ','g'),'')"
    return f"coalesce({exact(text, K.OCR_LABELS)},{first_contained(text, K.OCR_LABELS)})"


def short_label(col: str) -> str:
    key = f"regexp_replace(trim(regexp_replace(upper({col}),'[^A-Z0-9. ]','','g')),'\\s+',' ','g')"
    bare = f"trim(regexp_replace({key},'\\s*\\d+$',''))"
    return f"coalesce({exact(key, K.SHORT_LABELS)},{exact(bare, K.SHORT_LABELS)})"


def block_hint(col: str, part: int) -> str:
    """part 0: word, 1: room, 2: confidence."""
    ranked = sorted(K.BLOCK_HINTS.items(), key=lambda kv: -kv[1][1])
    return case(((f"contains(upper({col}),'{w}')", lit((w, *hint)[part])) for w, hint in ranked), ("'GENERIC'", "''", "0.0::DOUBLE")[part])


def geometry(part: int, area: str = "area_sqft", aspect: str = "aspect", compact: str = "compactness") -> str:
    """part 0: label, 1: confidence."""
    pairs = [(f"{aspect}>=3.5 AND {area}>=40", ("Corridor", 0.78)), (f"{compact}<0.45 AND {area}>80", ("Hall", 0.55)), *((f"{area}<{m}", (t, c)) for m, t, c in K.AREA_RULES)]
    return case(((c, lit(v[part])) for c, v in pairs), lit(K.OPEN_AREA[part]))


def geometry_v1(area: str = "area_sqft", aspect: str = "aspect", doors: str = "door_count") -> str:
    pairs = [(f"{aspect}>=4 AND {area}>=40", "'Corridor'"), (f"{doors}=0 AND {area}<25", "'Utility'"), *((f"{area}<{m}", lit(t)) for m, t in K.AREA_RULES_V1)]
    return case(pairs, "'Open Area'")


def goes_with(candidate: str, name: str) -> str:
    """Whether a neighbour's name is one of those listed for the candidate."""
    return "coalesce(" + " OR ".join(f"({candidate}='{k}' AND {name} IN ({','.join(map(lit, v))}))" for k, v in K.NEXT_TO.items()) + ",FALSE)"


def near_confidence(candidate: str, names: list[str]) -> str:
    hits = "+".join(f"CASE WHEN {goes_with(candidate, n)} THEN 1 ELSE 0 END" for n in names)
    hosted = " OR ".join(goes_with(n, candidate) for n in names)
    return f"CASE WHEN {hits}>0 THEN least(0.85::DOUBLE,0.4::DOUBLE+0.15::DOUBLE*({hits})) WHEN {hosted} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"


def vote(signals: list[tuple[str, str]]) -> tuple[str, str]:
    """(label, confidence) of four (label, confidence) signals."""
    weighed = [f"(CASE WHEN {label}<>'' AND {sure}>0 THEN {sure}*{w!r}::DOUBLE ELSE 0.0::DOUBLE END)" for (label, sure), w in zip(signals, K.WEIGHTS)]
    totals = []
    for k, (label, _) in enumerate(signals):
        votes = "+".join(f"(CASE WHEN {w}>0 AND {other}={label} THEN {w} ELSE 0.0::DOUBLE END)" for (other, _), w in zip(signals, weighed))
        totals.append(f"(CASE WHEN {weighed[k]}>0 THEN 0.0::DOUBLE+{votes} ELSE -1.0::DOUBLE END)")
    top = f"greatest({','.join(totals)})"
    label = case(((f"{t}={top}", s[0]) for t, s in zip(totals, signals)), signals[0][0])
    weights = f"{K.WEIGHTS[0]!r}::DOUBLE" + "".join(f"+(CASE WHEN {s[1]}>0 THEN {w!r}::DOUBLE ELSE 0.0::DOUBLE END)" for s, w in list(zip(signals, K.WEIGHTS))[1:])
    return label, f"least(1.0::DOUBLE,{top}/({weights}))"


#: Distance of a point (x, y) from the line of a rectangle x0..x1, y0..y1, and whether it lies strictly inside.
INSIDE = "(x>x0 AND x<x1 AND y>y0 AND y<y1)"
TO_LINE = f"CASE WHEN {INSIDE} THEN least(x-x0,x1-x,y-y0,y1-y) ELSE sqrt(power(greatest(x0-x,0,x-x1),2)+power(greatest(y0-y,0,y-y1),2)) END"
