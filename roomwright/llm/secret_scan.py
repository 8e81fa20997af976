"""Secret scanning with DataFrame operations only: patterns, and two character Markov models compared by log-likelihood.

The base patterns find assigned values, access keys and long hex strings. Besides, every run of 16 or more token
characters with a letter and a digit is scored by two first-order Markov chains over characters, one of random strings and
one of ordinary identifiers; a run whose log-likelihood ratio exceeds `MEAN_RATIO` per transition is a span of kind
`random`, unless it touches a base span.

Both chains are counted from labelled samples: rows (word, secret). `labelled_samples` makes them: random strings of
several alphabets from digests of a counter, and identifiers joined from the words of a bounded sample of documents
(about `SAMPLE_DOCS`, chosen by a hash of the id).

Positions: a text is split at a pattern's matches, and the lengths of the parts before each match are summed up, in code
points. Texts without a match only meet the pattern once. Matches are gathered, and texts redacted, in blocks of `BLOCK`, so
that a text of very many matches copies no growing array or string for each of them.

Defined results: a null text is empty and has no spans; rows are independent, so repeated rows, null ids and extra columns of
any name change nothing (but for the column that out_col names, which is replaced); without documents the identifiers' chain is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted

#: The base patterns, in the order of their kinds, the group that must be so long, and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
MEAN_RATIO = 0.6
SAMPLE_DOCS, SAMPLE_STRINGS = 400, 4_000
BLOCK = 512
SPAN = "array<struct<start:int,stop:int,rank:int,kind:string>>"


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, stop, word>> of the leftmost non-overlapping matches whose group has `least` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    word = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("before"), whole.alias("whole"), word.alias("word"))
    none = F.array().cast("array<struct<start:int,stop:int,word:string>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["before"])
        stop = start + F.coalesce(F.length(part["whole"]), F.lit(0))
        found = F.struct(start.alias("start"), stop.alias("stop"), part["word"].alias("word"))
        longer = F.coalesce(F.length(part["word"]), F.lit(0)) >= least
        return F.struct(stop.alias("at"), F.when(longer, F.array_append(state["out"], found)).otherwise(state["out"]).alias("out"))

    def block(state: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.array_append(state["out"], x["out"]).alias("out")))

    blocks = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int,word:string>>>").alias("out"))
    scan = _let(parts, lambda p: F.aggregate(_blocks(p), blocks, block, lambda state: F.flatten(state["out"])))
    return F.when(text.rlike(pattern), scan).otherwise(none)


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK items."""
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array())


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(word, secret): random strings and ordinary identifiers."""
    spark = docs.sparkSession
    base64 = F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id")), 256)))
    seeds = spark.range(strings).withColumn("id", F.col("id").cast("string")).select(
        F.explode(F.array(
            F.substring(F.sha2("id", 256), 1, 40),
            F.regexp_replace(base64, "=+$", ""),
            F.regexp_replace(base64, "[^A-Za-z0-9]", ""),
            F.concat(F.lit("AKIA"), F.regexp_replace(F.upper(base64), "[^A-Z0-9]", "")),
        )).alias("word"), F.lit(True).alias("secret"),
    )
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).where("_text is not null")
    count = max(1, rows.count())
    chance = F.pmod(F.xxhash64(F.coalesce("_id", F.lit("")), F.lit(8)), F.lit(1_000_000)) / 1e6
    words = F.regexp_extract_all(F.col("_text"), F.lit("[A-Za-z]{2,}"), F.lit(0))
    glue = F.array(*map(F.lit, ("_", "-", "/", "", "_2", "-10", "/2024/", "_v1_")))

    def join(k: Column) -> Column:
        one, two = F.get("w", k), F.get("w", k + 1)
        return F.concat(one, F.get(glue, F.pmod(F.xxhash64(one, two), F.lit(8)).cast("int")), two)

    names = rows.where(chance < min(1.0, sample_docs / count)).select(words.alias("w")).where(F.size("w") > 1)
    names = names.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), join)).alias("word"), F.lit(False).alias("secret"))
    return seeds.unionByName(names)


def fit_ratios(samples: DataFrame) -> list[float]:
    """log P(next | char, random) - log P(next | char, identifier) for each pair of CHARS, row by row (add-one smoothing)."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring(F.col("word"), k, F.lit(2)))
    counted = samples.where(F.length("word") > 1).select("secret", F.explode(pairs).alias("pair")).groupBy("secret", "pair").count().where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    size, place = len(CHARS), {c: k for k, c in enumerate(CHARS)}
    counts = {True: [[1.0] * size for _ in CHARS], False: [[1.0] * size for _ in CHARS]}
    for r in counted.collect():  # at most 2 * size**2 rows
        counts[r.secret][place[r.pair[0]]][place[r.pair[1]]] += r["count"]
    logs = {k: [[math.log(x / sum(row)) for x in row] for row in table] for k, table in counts.items()}
    return [round(a - b, 5) for rows in zip(logs[True], logs[False]) for a, b in zip(*rows)]


def ratio(word: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a word's transitions; characters outside CHARS are skipped."""
    table = F.from_json(F.lit("[" + ",".join(map(str, ratios)) + "]"), "array<double>")

    def step(state: Column, char: Column) -> Column:
        here = F.instr(F.lit(CHARS), char) - 1
        gain = F.when(state["last"] < 0, F.lit(0.0)).otherwise(F.get(table, state["last"] * len(CHARS) + here))
        return F.when(here < 0, state).otherwise(F.struct(here.alias("last"), (state["sum"] + gain).alias("sum"), (state["n"] + 1).alias("n")))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(F.split(word, ""), start, step, lambda state: state["sum"] / F.greatest(state["n"] - 1, F.lit(1)))


def secret_spans(docs: DataFrame, ratios: list[float], text_col: str = "text", out_col: str = "spans", mean_ratio: float = MEAN_RATIO) -> DataFrame:
    """Adds out_col: array<struct<start, stop, rank, kind>> in order of start and kind; code points, stop exclusive."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def tagged(found: Column, rank: int, kind: str) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))).cast(SPAN)

    base = F.concat(*[tagged(matches(text, pattern, group, least), k, kind) for k, (kind, pattern, group, least) in enumerate(BASE)])
    runs = matches(text, RUN, 0, 16)
    own, inner = free_name(docs, "_base"), free_name(docs, "_wrapped")
    found = F.col(own)
    odd = F.filter(runs, lambda m: (ratio(m["word"], ratios) > mean_ratio) & ~F.exists(found, lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    kept = [quoted(c) for c in docs.columns if c != out_col]
    #: In a struct, so that the optimizer does not put the scan for base spans into every place that reads it.
    scanned = docs.select(*map(quoted, docs.columns), F.struct(base.alias("x")).alias(inner)).withColumn(own, F.col(f"{inner}.x"))
    return scanned.select(*kept, F.array_sort(F.concat(found, tagged(odd, len(BASE), "random"))).alias(out_col))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch covered by spans (ordered by start) replaced by one mark."""

    def stretch(own: Column, begin: Column) -> Column:
        """The marked text from code point `begin` to the end of the block's last span; `part` is that text unmarked."""
        end = F.greatest(begin, F.array_max(F.transform(own, lambda s: s["stop"])))

        def step(part: Column, state: Column, s: Column) -> Column:
            apart = (s["start"] > state["at"]) | (state["at"] == 0)
            piece = F.when(apart, F.concat(F.substring(part, state["at"] - begin + 1, s["start"] - state["at"]), F.lit(mark))).otherwise("")
            return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.array_append(state["out"], piece).alias("out"))

        start = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out"))
        return _let(F.substring(text, begin + 1, end - begin), lambda part: F.aggregate(own, start, lambda state, s: step(part, state, s)))

    def block(state: Column, own: Column) -> Column:
        return _let(stretch(own, state["at"]), lambda x: F.struct(x["at"].alias("at"), F.array_append(state["out"], F.array_join(x["out"], "")).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = F.aggregate(_blocks(spans), begin, block, lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, end).otherwise(text)
