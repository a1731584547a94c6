import random
import zlib

import numpy as np
import pytest
import zstandard

from tidewright.llm import language, quality, queries

SF = "/root/testdata/sf0.1"


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op3_quality_classifier(spark, SF).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = [p for p, q in held if q == 1]
    bad = [p for p, q in held if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_language_on_held_out_documents(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op4_language_id(spark, SF).collect()
    held = [(r["lang_pred"], docs[r["doc_id"]]) for r in rows if r["held_out"] and docs[r["doc_id"]]]
    assert len(rows) == len(docs) and np.mean([a == b for a, b in held]) > 0.99
    assert np.mean([r["rejected"] for r in rows]) < 0.05


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "p"), (2, "", "q"), (3, "x" * 200_000, "r"), (None, "some text", "s"), (3, "x" * 200_000, "r")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == 5 and all(abs(r["score"] - 0.5) < 1e-9 and r["predicted"] == 0 for r in got)
    odd = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (3, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, quality.fit(docs, odd)).count() == 5
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_quality_learns_from_rows_that_are_not_held_out_only(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "good text " * (i % 7 + 1) if i % 2 else "%%% ### " * (i % 5 + 1)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert abs(model.prior - 0.5) < 1e-9 and not model.weights[1:].any()


def test_quality_fit_separates_and_does_not_depend_on_order():
    rng = np.random.default_rng(0)
    words = ["the", "sea", "tide", "wright", "harbour", "builds", "ships", "slowly"]
    good = [(1, " ".join(rng.choice(words, 60))) for _ in range(80)]
    bad = [(0, " ".join(w + "$$$" for w in rng.choice(words, 60))) for _ in range(80)]
    model = quality.fit_rows(good + bad)
    assert (model.scores([t for _, t in good]) > 0.7).mean() > 0.95 and (model.scores([t for _, t in bad]) < 0.3).mean() > 0.95


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (3, "hello there", None), (None, "bonjour", "fr"), (5, "", "en")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = {(r["doc_id"], r["text"] if "text" in r.asDict() else None): r for r in language.identify_languages(docs, model).collect()}
    said = {k[0]: r["lang_pred"] for k, r in got.items()}
    assert said[1] == said[2] == said[5] == "und" and said[3] == said[None] == "fr"
    nothing = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify_languages(docs, nothing).collect()} == {"und"}
    assert language.identify_languages(docs.limit(0), model).count() == 0


def test_grams_by_definition():
    counts = language.gram_counts("Ab, c", 1 << 14)
    assert counts.sum() == (len(" ab c ") - 1) + (len(" ab c ") - 2)
    assert language.gram_counts("12 %", 64) is None and language.gram_counts("", 64) is None
    assert np.array_equal(language.gram_counts("AB c", 512), language.gram_counts("ab--C!", 512))


def test_clusters_are_unit_and_cover():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = language.clusters(x, 4)
    assert 1 <= len(c) <= 4 and np.allclose(np.linalg.norm(c, axis=1), 1)


def test_far_texts_are_rejected():
    rows = [("en", "the cat sat on the mat and the dog ran " * k) for k in range(1, 9)] + [("fr", "le chat est sur la table et le chien court " * k) for k in range(1, 9)]
    model = language.fit_rows(rows)
    assert model.predict(["the dog sat"])[0][0] == "en" and model.predict(["le chien est la"])[0][0] == "fr"
    assert model.predict(["Ωμέγα άλφα βήτα γάμμα δέλτα"])[0][2]


def plain_score(model, text):
    """The score by its definition: one text, fresh compressors, every chunk alone."""
    raw, sizes = text.encode(), []
    for d in (model.good, model.bad):
        size = 0
        for k in range(0, len(raw), 1024):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            size += len(c.compress(raw[k : k + 1024]))
        sizes.append(size)
    if not raw:
        return model.prior
    return 1 / (1 + np.exp(-(model.weights[0] + model.weights[1] * (sizes[1] - sizes[0]) / len(raw))))


def labelled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = spark.read.parquet(f"{sf}/labels.parquet").join(docs, "doc_id").select("doc_id", "quality", "text").collect()
    rows = sorted((r["doc_id"], r["quality"], r["text"] or "") for r in rows)
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 4 == 2
    return [r[1:] for r in rows if not held(r)], [r[1:] for r in rows if held(r)]


def test_quality_query_against_plain_scoring(spark):
    sf = "/root/testdata/sf0.001"
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_quality_classifier(spark, sf).collect()
    assert len(got) == len(texts) and len(model.good) == len(model.bad)
    assert all(abs(r["score"] - plain_score(model, texts[r["doc_id"]])) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


@pytest.mark.parametrize("per_class,copies", [(400, 1), (780, 5), (2000, 5), (4000, 1), (4000, 5)])
def test_quality_fit_holds_over_seeds_sizes_and_copies(spark, per_class, copies):
    train, held = labelled(spark, SF)
    sizes = {q: sum(a == q for a, _ in train) for q in (0, 1)}
    bad = [t for q, t in held if q == 0]
    good = [t for q, t in held if q == 1]
    for seed in range(10):
        rng = random.Random(seed)
        rows = []
        for q in (0, 1):
            mine = [r for r in train if r[0] == q] * copies
            rng.shuffle(mine)
            rows += mine[:per_class]
        rng.shuffle(rows)
        model = quality.fit_rows(rows, sizes)
        assert len(model.good) == len(model.bad)
        assert (model.scores(good) >= 0.7).mean() >= 0.97 and (model.scores(bad) >= 0.7).mean() <= 0.2


def test_logistic_finds_the_minimum_from_hard_samples():
    rng = np.random.default_rng(4)
    for scale, n in ((1, 50), (1000, 50), (1e-3, 400), (50, 4000)):
        x = np.concatenate([rng.standard_normal((n, 1)) - 3, rng.standard_normal((max(2, n // 20), 1)) * 0.01 + 4]) * scale
        y = np.array([0.0] * n + [1.0] * (len(x) - n))
        w = quality.logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(w[0] + x[:, 0] * w[1], -500, 500)))
        slope = np.array([(p - y).sum(), (x[:, 0] * (p - y)).sum()]) + 0.01 * w
        assert np.abs(slope).max() < 1e-4 * len(y) * scale
    with pytest.raises(RuntimeError):
        quality.logistic(x, y, rounds=1)


def test_quality_keeps_every_other_column(spark):
    docs = spark.createDataFrame([(1, "a b", 2, 3, 4), (1, "a b", 2, 3, 4), (2, None, 5, 6, 7)], "doc_id long, text string, scored_text int, Score_ int, _text int")
    got = quality.score_quality(docs, quality.fit_rows([(1, "good text"), (0, "bad")]))
    assert got.columns == [*docs.columns, "score", "predicted"] and [tuple(r)[2:5] for r in got.collect()] == [(2, 3, 4), (2, 3, 4), (5, 6, 7)]


def plain_language(model, text, buckets=1 << 14):
    """The nearest centroid by definition: counts in a dict, cosine by plain sums."""
    counts = language.gram_counts(text or "", buckets)
    if counts is None:
        return "und", 0.0
    v = {i: float(np.sqrt(counts[i])) * float(model.idf[i]) for i in np.flatnonzero(counts)}
    norm = sum(x * x for x in v.values()) ** 0.5
    best = {}
    for lang, c in zip(model.langs, model.centroids, strict=True):
        best[lang] = max(best.get(lang, -2.0), sum(x * float(c[i]) for i, x in v.items()) / norm)
    first = max(best, key=best.get)
    return first, 1 / sum(np.exp(30 * (b - best[first])) for b in best.values())


def test_language_query_against_plain_nearest_centroid(spark):
    sf = "/root/testdata/sf0.001"
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score = plain_language(model, texts[r["doc_id"]])
        assert abs(r["score"] - score) < 1e-3 and (r["lang_pred"] == lang or score < 0.51)


def test_language_keeps_every_other_column_and_codes_rows_alone(spark):
    docs = spark.createDataFrame([(1, "the sea", "en", 1, 2), (1, "the sea", "en", 1, 2), (2, "la mer " * 50_000, "fr", 3, 4), (3, "la mer", "fr", 5, 6)], "doc_id long, text string, lang string, lang_text int, _lang_text int")
    got = language.identify_languages(docs, language.fit_rows([("en", "the sea"), ("fr", "la mer")]))
    assert got.columns == [*docs.columns, "lang_pred", "score", "rejected"]
    rows = got.collect()
    assert [r["lang_pred"] for r in rows] == ["en", "en", "fr", "fr"] and rows[0] == rows[1] and [r["_lang_text"] for r in rows] == [2, 2, 4, 6]
