import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from roomwright.llm import language_id as lid  # noqa: E402
from roomwright.llm import secret_scan  # noqa: E402
from tests_llm_helpers import check_pieces, plain_classes, plain_fingerprint, spans_by_hand  # noqa: E402

SF = "/root/testdata/sf0.01"


def kept_by_hand(stage, docs, spark, frame):
    """What a stage should leave of docs, {doc_id: text}, by comparing everything in plain Python."""
    if stage == "language_id":
        profiles = lid.fit_profiles(frame.where(~(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)))
        letters = lid.Letters()
        out = {}
        for i, t in docs.items():
            (name,), (score,) = profiles.classify([t], letters)
            if name != "und" and score >= corpus_pipeline.LEAST_COSINE:
                out[i] = t
        return out
    if stage == "exact_dedup":
        return {i: t for i, t in docs.items() if i == max(j for j, u in docs.items() if u == t)}
    if stage == "simhash_dedup":
        classes = plain_classes({i: plain_fingerprint(t) for i, t in docs.items()})
        return {i: t for i, t in docs.items() if classes[i] == i}
    ratios = secret_scan.fit_ratios(secret_scan.labelled_samples(frame))
    out = {}
    for i, t in docs.items():
        text, at = "", 0
        for a, b in spans_by_hand(t, ratios):
            text, at = text + t[at:a] + "[SECRET]", b
        out[i] = text + t[at:]
    return out


def test_every_stage_is_brute_force(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "secret_scan", "packing"]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = {r.doc_id: r.text for r in frame.collect()}
        stage(spark, frame, SF).write.parquet(str(tmp_path / name))
        want = kept_by_hand(name, docs, spark, frame)
        frame = spark.read.parquet(str(tmp_path / name))
        assert frame.columns == columns
        rows = frame.collect()
        assert len(rows) == len({r.doc_id for r in rows})
        assert {r.doc_id: r.text for r in rows} == want, name
        sizes.append(len(rows))
    print(sizes)
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    check_pieces(last, {r.doc_id: r.text for r in rows}, 4096, 2)
    key = lambda r: tuple(sorted(r.asDict().items()))
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, last))


def test_texts_of_one_id_are_told_apart(spark):
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(40)) for w in ("river", "stone", "cloud", "grass"))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (3, c), (9, d), (None, a), (2, a + " riverend"), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact_stage(spark, docs, SF)
    found = lambda f: sorted(((r.doc_id, r.text) for r in f.collect()), key=str)
    assert found(exact) == sorted([(None, a), (None, b), (7, c), (9, d), (2, a + " riverend"), (4, "")], key=str)
    near = corpus_pipeline.near_stage(spark, docs, SF)
    prints = {t: plain_fingerprint(t or "") for _, t in rows}
    want, texts = [], [(i, t or "") for i, t in rows]
    classes = plain_classes(dict(enumerate(prints[t] for _, t in rows)))
    for k in set(classes.values()):
        own = [texts[j] for j in classes if classes[j] == k]
        want.append(min(own, key=lambda r: (r[0] is None, r[0])))
    assert found(near) == sorted(want, key=str)


def test_near_classes_that_share_an_id_stay_apart(spark):
    a, b = (" ".join(f"{w}{k}" for k in range(40)) for w in ("river", "stone"))
    docs = spark.createDataFrame([(7, a, "en", "s", 1), (7, b, "en", "s", 1), (3, a, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, SF).collect()) == [(3, a), (7, b)]


def test_short_texts_of_a_learned_language_stay(spark):
    short = [(100_001, "A."), (100_002, "A.\nAll rights reserved."), (100_003, "Lllldoado."), (100_004, "Avec."), (100_005, "zq"), (100_006, "12 34!"), (100_007, "xq jzv kwq zxj qvk jqz " * 6)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in short], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.language_stage(spark, docs.unionByName(more), SF).where("doc_id > 100000")
    assert {r.doc_id for r in left.collect()} == {100_001, 100_002, 100_003, 100_004, 100_005}


def test_stages_that_keep_short_texts_are_brute_force(spark, tmp_path):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    profiles, letters = lid.fit_profiles(frame.where(~(F.crc32(F.col("doc_id").cast("string")) % 4 == 2))), lid.Letters()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = {r.doc_id: r.text for r in frame.collect()}
        if name == "language_id":
            want = {}
            for i, t in docs.items():
                (lang,), (score,) = profiles.classify([t], letters)
                if lang != "und" and (score >= corpus_pipeline.LEAST_COSINE or sum(map(str.isalpha, t)) < corpus_pipeline.LEAST_LETTERS):
                    want[i] = t
        else:
            want = kept_by_hand(name, docs, spark, frame)
        stage(spark, frame, SF).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        rows = frame.collect()
        assert len(rows) == len(want) and {r.doc_id: r.text for r in rows} == want, name
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    check_pieces(last, {r.doc_id: r.text for r in rows}, 4096, 2)


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = "the cat and the dog sat on the mat with a friend of theirs"
    rows = [(1, good, "en", "s", 10), (1, good, "en", "s", 10), (2, None, None, None, None), (3, "", "en", None, 0), (None, good + " again", None, None, 5), (5, "1234 !!", None, "s", 7), (6, good, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.columns == docs.columns
        left = sorted((str(r.doc_id) for r in frame.collect()))
        assert left in (["6", "None"], [])
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == len(left)


def test_columns_of_any_name(spark):
    names = ["_w", "_base", "_text", "_spans", "_key", "_row", "_id", "extra", "key", "fp", "a.b", "odd`name"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in names)
    texts = {1: "the cat and the dog sat on the mat with a friend of theirs", 2: "the secret of the house is token = abcdef123 and nothing but that", 3: None}
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *range(len(names))) for i, t in texts.items()], schema)
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
    rows = sorted(frame.collect())
    assert [r.doc_id for r in rows] == [1, 2] and all(tuple(r)[5:] == tuple(range(len(names))) for r in rows)
    assert rows[1].text == "the secret of the house is [SECRET] and nothing but that" and rows[1].n_chars == len(rows[1].text)
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == 2


def test_run_leaves_only_what_its_result_reads(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert left <= {"pipeline-secret_scan", "packing-ids", "packing-order"}
