import numpy as np

from roomwright.llm import language_id as lid
from roomwright.llm.registry import QUERIES


def plain_vector(text, letters):
    """The bundle of trigram vectors, one trigram at a time."""
    import re

    words = re.findall(r"[^\W\d_]+", text.lower())
    chars = [""]
    for w in words:
        chars += [*w, ""]
    v = np.zeros(letters.dim)
    vec = lambda c: letters.vectors[letters.known[c]].astype(int)
    for a, b, c in zip(chars, chars[1:], chars[2:]):
        v += np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c)
    return v


def test_vectors_are_bundles():
    letters = lid.Letters(64)
    texts = ["", "a", "The cat, the  hat!", "12 ..", "Été à la Überraschung", "x" * 5000, "日本語 abc"]
    got = lid.text_vectors(texts, letters)
    for t, v in zip(texts, got):
        assert np.array_equal(v, plain_vector(t, letters)), t


def test_large_alphabets_take_the_same_path_result():
    letters = lid.Letters(32)
    text = "".join(chr(0x4E00 + k * 7 % 900) for k in range(1500)) + " abc"
    assert np.array_equal(lid.text_vectors([text], letters)[0], plain_vector(text, letters))


def test_odd_rows(spark):
    rows = [(1, "hello there my good friend", "en", "a"), (2, "bonjour mon cher ami voila", "fr", "b"), (3, None, "en", None), (4, "123 !!", None, None), (None, "hello friend", None, "x"), (4, "bonjour ami", None, "y"), (5, "", None, None), (6, "hello there " * 30000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    profiles = lid.fit_profiles(docs)
    assert profiles.languages == ["en", "fr"]
    got = sorted(((r.doc_id, r.lang_pred) for r in lid.predict_language(docs, profiles).collect()), key=str)
    assert got == sorted([(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (None, "en"), (4, "fr"), (5, "und"), (6, "en")], key=str)
    assert all(0 <= r.score <= 1 for r in lid.predict_language(docs, profiles).collect())
    assert lid.predict_language(docs.limit(0), profiles).count() == 0
    nothing = lid.fit_profiles(docs.limit(0))
    assert {r.lang_pred for r in lid.predict_language(docs, nothing).collect()} == {"und"}


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op3_language_id"](spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert 0.2 < len(held) / len(got) < 0.3
    right = sum(docs[r.doc_id] == r.lang_pred for r in held) / len(held)
    print("accuracy", right)
    assert right > 0.97


def test_wide_alphabets_and_long_texts_stay_small(monkeypatch):
    """300,000 random characters out of 20,000: pieces and blocks give what one step gives."""
    import tracemalloc

    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 20_000, 300_000).tolist()))
    letters = lid.Letters(64)
    tracemalloc.start()
    got = lid.text_vectors([text, "abc", text[:10]], letters)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got[0], plain_vector(text, letters)) and np.array_equal(got[2], plain_vector(text[:10], letters))
    assert peak < 100 << 20
    monkeypatch.setattr(lid, "CHARS_AT_ONCE", 1000)
    monkeypatch.setattr(lid, "GRAMS_AT_ONCE", 77)
    again = lid.text_vectors([text[:20_000], "The cat sat. " * 500], letters)
    assert np.array_equal(again[0], plain_vector(text[:20_000], letters)) and np.array_equal(again[1], plain_vector("The cat sat. " * 500, letters))


def test_scores_of_few_letters_are_near_one_half():
    letters = lid.Letters()
    words = "the cat and the dog sat on the mat with a friend of theirs "
    v = lid.text_vectors([words * 50], letters)[0]
    profiles = lid.Profiles(["en"], (v / np.linalg.norm(v))[None].astype(float))
    names, scores = profiles.classify(["q", "qz xk", "xkqz vjq zzx " * 40, words * 3, None], letters)
    assert names == ["en", "en", "en", "en", "und"]
    assert 0.4 < scores[0] <= 0.5 and 0.2 < scores[1] < 0.5 and scores[2] < 0.1 and scores[3] > 0.9 and scores[4] == 0


def test_query_equals_a_plain_form(spark):
    """held_out, und and the predictions of the whole table, one text and one trigram at a time."""
    import zlib

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.select("doc_id", "text", "lang").collect()}
    learned = [r for r in rows.values() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None]
    letters = lid.Letters()
    lid.text_vectors([r.text for r in rows.values() if r.text], letters)
    own = {i: plain_vector(r.text, letters) for i, r in rows.items() if r.text and len(r.text) < 4000}
    sums = {}
    for r in learned:
        sums[r.lang] = sums.get(r.lang, 0) + (own[r.doc_id] if r.doc_id in own else lid.text_vectors([r.text], letters)[0])
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, sf).collect()}
    assert len(got) == len(rows)
    names = sorted(sums)
    protos = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    for i, r in rows.items():
        g = got[i]
        assert g.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(map(str.isalpha, r.text or "")):
            assert (g.lang_pred, g.score) == ("und", 0.0)
        elif i in own:
            cosine = protos @ own[i] / np.linalg.norm(own[i])
            assert cosine[names.index(g.lang_pred)] > cosine.max() - 1e-4
            assert 0 <= g.score <= 1
