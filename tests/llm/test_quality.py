import random

from roomwright.llm import quality
from roomwright.llm.registry import QUERIES


def test_features():
    f = quality.Featurizer()
    assert f("") == set() and f("a b") == f("b  a\nb")
    assert quality.REPEATED in f("go go") and quality.REPEATED not in f("go stop go")
    assert f("Don't!") == {quality._bucket("word don't"), quality._bucket("mark 1 !")}


def test_fit_orders_grades():
    rng = random.Random(2)
    plain = [f"w{k}" for k in range(200)]
    rows = []
    f = quality.Featurizer()
    for k in range(600):
        words = rng.choices(plain, k=rng.randint(5, 200))
        grade = k % 3
        if grade == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["awful", "nasty"]))
        if grade == 1:
            words = [w + "###" for w in words]
        rows.append((f(" ".join(words)), grade))
    model = quality.fit_ordinal(rows[:450], 3)
    assert model.thresholds[0] < model.thresholds[1]
    lowest = set(sorted(model.weights, key=model.weights.get)[:3])
    assert lowest == {quality._bucket("word awful"), quality._bucket("word nasty"), quality._bucket("mark 1 ###")}
    right = 0
    for fs, grade in rows[450:]:
        tails = model.tails(fs)
        assert tails[0] >= tails[1]
        right += round(sum(tails)) == grade
    assert right / 150 > 0.95
    assert quality.fit_ordinal([], 3).tails(set()) == [0.5, 0.5]
    assert len(quality.fit_ordinal([(f("a"), 1)], 3).thresholds) == 2


def test_odd_rows(spark):
    rows = [(1, "good words here", "x"), (2, None, None), (3, "", None), (None, "good words", "x"), (1, "good words here", "x"), (4, "bad bad " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tail string")
    labels = spark.createDataFrame([(1, 2), (4, 0), (4, None), (None, 1), (2, 1)], "doc_id long, grade int")
    model = quality.fit_quality(docs, labels, 3)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.expected_grade <= 2 and len(r.tail) == 2 for r in got)
    assert quality.score_quality(docs.limit(0), model).count() == 0
    nothing = quality.fit_quality(docs.limit(0), labels.limit(0), 3)
    assert {tuple(r.tail) for r in quality.score_quality(docs, nothing).collect()} == {(0.5, 0.5)}


def test_held_out_documents(spark):
    """Fitted on half of the labels, judged on the other half."""
    from pyspark.sql import functions as F

    from roomwright.llm.registry import GRADES, LEAST_GOOD, grades_of

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    model = quality.fit_quality(docs, grades_of(labels.where(half == 0)), GRADES)
    scored = quality.score_quality(docs, model).join(labels.where(half == 1), "doc_id")
    kept = F.avg((F.get("tail", F.lit(1)) >= LEAST_GOOD).cast("double"))
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")
    got = {r.kind: r.kept for r in scored.groupBy(kind.alias("kind")).agg(kept.alias("kept")).collect()}
    print(got)
    assert got["clean"] > 0.98 and got["toxic"] < 0.1 and got["poor"] < 0.35


def test_query_finds_toxic_and_poor_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op9_quality"](spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == docs.keys()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    for name, own in (("toxic", [r for r in labels if r.toxic]), ("poor", [r for r in labels if not r.toxic and not r.quality]), ("clean", [r for r in labels if not r.toxic and r.quality])):
        grades = [round(got[r.doc_id].expected_grade) for r in own]
        share = sum(got[r.doc_id].kept for r in own) / len(own)
        print(name, len(own), [grades.count(k) / len(own) for k in range(3)], share)
        assert share > 0.99 if name == "clean" else share < (0.05 if name == "toxic" else 0.2)


def plain_features(text):
    """A text's features, stretch by stretch and without memory."""
    import re
    import zlib

    def bucket(f):
        return zlib.crc32(f.encode()) % quality.BUCKETS

    out, last = set(), None
    for s in text.split():
        core = re.search(r"\w+(?:[^\w\s]+\w+)*", s)
        if core:
            word = core[0].lower()
            out.add(bucket("word " + word))
            out.update(bucket("stem " + word[:k]) for k in (5, 7) if len(word) > k)
            out.update(bucket(f"mark {k} {m}") for k, m in enumerate((s[: core.start()], s[core.end() :])) if m)
        else:
            out.add(bucket("marks " + s))
        if s == last:
            out.add(quality.REPEATED)
        last = s
    return out


def test_query_is_brute_force(spark):
    """All documents and labels in plain Python: the sample, the features, the probabilities and the selection."""
    import math

    from roomwright.llm.registry import LEAST_GOOD

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    grades = {(r.doc_id, 0 if r.toxic == 1 else 1 if r.quality == 0 else 2) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic == 1 or r.quality is not None}
    found = {i: plain_features(t) for i, t in docs.items()}
    model = quality.fit_ordinal([(sorted(found[i]), g) for i, g in grades if i in docs], 3)
    got = {r.doc_id: r for r in QUERIES["op9_quality"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, fs in found.items():
        score = sum(w for f, w in model.weights.items() if f in fs)
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(got[i].expected_grade - sum(tails)) < 1e-9 and abs(got[i].p_good - tails[1]) < 1e-9
        assert got[i].kept == (tails[1] >= LEAST_GOOD)


def test_fit_reaches_the_likelihood_of_plain_gradient_steps():
    """On a small problem no plain subgradient step from the fitted weights gains much."""
    import math

    rng = random.Random(4)
    rows = [({k for k in range(6) if rng.random() < 0.4}, rng.randrange(3)) for _ in range(200)]
    rows = [(fs | {10 + g} if rng.random() < 0.7 else fs, g) for fs, g in rows]
    model = quality.fit_ordinal([(sorted(fs), g) for fs, g in rows], 3)

    def loss(weights, thresholds):
        total = 0.0
        for fs, g in rows:
            score = sum(weights.get(f, 0.0) for f in fs)
            for k, t in enumerate(thresholds):
                p = 1 / (1 + math.exp(t - score))
                total -= math.log(p if g > k else 1 - p) / len(rows)
        return total + quality.L1 * sum(map(abs, weights.values()))

    best = loss(model.weights, model.thresholds)
    for f in [*range(6), 10, 11, 12]:
        for step in (-0.2, 0.2):
            assert loss({**model.weights, f: model.weights.get(f, 0.0) + step}, model.thresholds) > best - 2e-3
    assert best < loss({}, model.thresholds) - 0.1


def test_bounds_of_the_sample(spark, monkeypatch):
    """A third of the rows carries one id and text; they count once, and the sample keeps its bounds."""
    texts = [(7, "same words again")] * 40 + [(k, f"word{k} other{k} third{k}") for k in range(100, 180)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 2)] * 30 + [(k, k % 3) for k in range(100, 180)], "doc_id long, grade int")
    seen = []
    monkeypatch.setattr(quality, "fit_ordinal", lambda rows, grades: seen.append(list(rows)))
    quality.fit_quality(docs, labels, 3)
    quality.fit_quality(docs, labels, 3, sample_rows=10)
    monkeypatch.setattr(quality, "SAMPLE_FEATURES", 50)
    quality.fit_quality(docs, labels, 3)
    assert [len(s) for s in seen[:2]] == [81, 10] and 0 < sum(len(f) for f, _ in seen[2]) <= 50


def test_report_on_a_last_quarter(spark):
    """Fitted on half of the labels, reported on the last quarter. Keeping 99 % of the clean documents of the third quarter would
    ask for a threshold of 0.3 instead of LEAST_GOOD, so both are reported."""
    from pyspark.sql import functions as F

    from roomwright.llm.registry import GRADES, LEAST_GOOD, grades_of

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    model = quality.fit_quality(docs, grades_of(labels.where(part < 2)), GRADES)
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")
    rows = quality.score_quality(docs, model).join(labels.where(part >= 2), "doc_id").select(part.alias("part"), kind.alias("kind"), F.get("tail", F.lit(1)).alias("p")).collect()

    def kept(k, name, least):
        own = [r.p for r in rows if r.part == k and r.kind == name]
        return sum(p >= least for p in own) / len(own)

    steps = [k / 10 for k in range(1, 10) if kept(2, "clean", k / 10) >= 0.99]
    report = {least: {name: round(kept(3, name, least), 4) for name in ("clean", "toxic", "poor")} for least in (max(steps), LEAST_GOOD)}
    print("threshold by the third quarter", max(steps), "shares kept of the last", report)
    for own in report.values():
        assert own["clean"] > 0.98 and own["toxic"] < 0.15 and own["poor"] < 0.4
