import hashlib

from pyspark.sql import functions as F

from roomwright.llm.exact_dedup import exact_dedup
from roomwright.llm.registry import ORACLE_SQL, QUERIES

ROWS = [(4, "a", "x"), (2, "a", "y"), (7, "b", None), (3, None, "z"), (9, "", "z"), (5, "a ", None), (None, "a", "q"), (None, "lonely", "q"), (6, "c" * 200_000, None), (8, "c" * 200_000, None), (8, "c" * 200_000, None)]


def by_hand(rows, best):
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(t or "", []).append(i)
    out = []
    for i, t, _ in rows:
        ids = [x for x in texts[t or ""] if x is not None]
        keep = best(ids) if ids else None
        out.append((i, keep, len(texts[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, kept string, _h int")
    assert got(exact_dedup(docs)) == by_hand(ROWS, min)
    assert got(exact_dedup(docs, keep="max")) == by_hand(ROWS, max)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_colliding_hashes_do_not_join_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, x string")
    for weak in (lambda t: F.lit("same"), lambda t: F.substring(F.sha2(t, 256), 1, 1)):
        assert got(exact_dedup(docs, hash_of=weak)) == by_hand(ROWS, min)


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op7_exact_dedup"]).fetchall()
    assert got(QUERIES["op7_exact_dedup"](spark, sf)) == sorted(map(tuple, want), key=repr)
