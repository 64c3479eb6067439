"""Quality, language and toxicity models, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from jetframe.llm import exact_dedup, jaccard_join, language_id, packing, quality, registry, toxicity
from jetframe.llm.texts import documents, labelled_sample
from jetframe.session import Shelf

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
KIND = "doc_id bigint, text string, lang string, label int, score int, predicted string, key int"


def table(spark, rows):
    filled = [(i, t, lang, 1, 2, "p", 3) for i, t, lang in rows]
    return spark.createDataFrame(filled, KIND).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def ids_where(modulus, wanted, count):
    found = [n for n in range(20 * count) if (zlib.crc32(str(n).encode()) % modulus in wanted)]
    return found[:count]


def auc(label, score):
    order = np.argsort(np.argsort(score, kind="stable"))
    ranks = order + 1.0
    for value in np.unique(score):
        same = score == value
        ranks[same] = ranks[same].mean()
    ones = label.sum()
    zeros = len(label) - ones
    return (ranks[label == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)


def held_out(spark, name, column):
    rows = {r["doc_id"]: r for r in registry.queries()[name](spark, SF).collect()}
    assert len(rows) == documents(spark, SF).count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    known = registry.labels(spark, SF).select("doc_id", column).collect()
    held = [(r[column], rows[r["doc_id"]]["score"]) for r in known if rows[r["doc_id"]]["held_out"]]
    return auc(*(np.array(c) for c in zip(*held, strict=True)))


def test_quality_held_out(spark):
    assert held_out(spark, "op1_quality", "quality") > 0.97


def test_toxicity_held_out(spark):
    assert held_out(spark, "op4_toxicity", "toxic") > 0.8


def test_language_held_out(spark):
    rows = registry.op3_language_id(spark, SF).filter("held_out").collect()
    known = {r["doc_id"]: r["lang"] for r in documents(spark, SF).collect()}
    right = [r["lang_pred"] == known[r["doc_id"]] for r in rows]
    assert np.mean(right) > 0.98
    crc = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in known}
    assert {r["doc_id"] for r in rows} == {i for i, h in crc.items() if h}


def test_quality_gradient():
    """The gradients of the network against differences."""
    rng = np.random.default_rng(1)
    offsets = np.array([0, 3, 4, 9])
    features = rng.random((9, quality.FEATURES))
    label = np.array([1.0, 0.0, 1.0])
    shapes = {"W": (quality.FEATURES, 5), "b": (5,), "V": (5, 4), "U": (5, 4), "w": (4,), "c": (5,), "d": ()}
    model = {n: rng.standard_normal(s) * 0.3 for n, s in shapes.items()}
    model |= {"mean": np.zeros(quality.FEATURES), "spread": np.ones(quality.FEATURES)}

    def loss(m):
        p = quality.forward(m, features, offsets)["p"]
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    found = quality.gradients(model, quality.forward(model, features, offsets), offsets, label)
    for name, shape in shapes.items():
        place = tuple(rng.integers(s) for s in shape)
        moved = []
        for step in (1e-6, -1e-6):
            other = dict(model)
            other[name] = np.array(model[name], dtype=float)
            other[name][place] += step
            moved.append(loss(other))
        assert found[name][place] == pytest.approx((moved[0] - moved[1]) / 2e-6, rel=1e-4, abs=1e-8)


def test_passages_cover_whole_texts():
    texts = [b"", b"  \n", b"one", b"a b c " * 1000, "é ü".encode() * 10]
    features, offsets = quality.passages(texts)
    assert np.diff(offsets).tolist() == [1, 1, 1, math.ceil(3000 / quality.PASSAGE_WORDS), 1]
    assert not features[:2].any() and features[2].any()
    alone = [quality.passages([t])[0] for t in texts]
    assert np.allclose(np.concatenate(alone), features)


def quality_rows(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "house", "river"]
    rows, marks = [], []
    for n in range(200):
        good = n % 2
        text = " ".join(w if good else w.upper() + "!!" for w in rng.choices(words, k=rng.choice([3, 60, 120])))
        rows.append((n, text, None))
        marks.append((n, good, 0))
    return rows, marks


def test_quality_edges(spark):
    rows, marks = quality_rows(spark)
    rows += [(900, None, None), (901, "", None), (902, "beta " * 30_000, None), (None, "x", None), (3, rows[3][1], None)]
    docs = table(spark, rows)
    got = quality.quality(docs, labels(spark, marks + [(5, None, None), (None, 1, 1)])).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got if (r["doc_id"] or 999) < 200]) > 0.95
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[900] == scores[901]
    assert quality.quality(docs.limit(0), labels(spark, marks)).count() == 0
    none = quality.quality(docs, labels(spark, [])).collect()
    assert {r["score"] for r in none} == {1.0}
    kept = quality.keep_good(docs, quality.constant(1.0))
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_toxicity_edges(spark):
    rng = random.Random(4)
    fill = [f"w{chr(97 + n)}{chr(97 + m)}" for n in range(20) for m in range(20)]
    rows, marks = [], []
    for n in range(600):
        words = rng.choices(fill, k=rng.choice([5, 30, 200]))
        kind = n % 6
        if kind == 0:  # toxic: a stem with changing endings
            words[2] = "vorpal" + rng.choice(["s", "ed", "ing", ""])
        if kind == 1:  # the same stem inside a harmless phrase
            words[2:4] = ["vorpal", "sword"]
        rows.append((n, " ".join(words), None))
        marks.append((n, 1, int(kind == 0)))
    docs = table(spark, rows)
    model = toxicity.train(docs, labels(spark, marks))
    assert "vorpal" in model.weights and all(w.startswith("vorpal") for w in model.weights)
    assert "vorpal sword" in model.exceptions
    extra = [(1000, "so V0RP4L, it is", None), (1001, "vоrраl", None), (1002, "unvorpal", None)]
    extra += [(1003, "a Vorpal sword", None), (1004, None, None), (1005, "", None), (1006, "wa " * 50_000, None)]
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, extra), model).collect()}
    assert [got[n]["predicted"] for n in range(1000, 1007)] == [1, 1, 0, 0, 0, 0, 0]
    assert got[1004]["score"] == got[1005]["score"] == got[1006]["score"] > 0
    scored = toxicity.toxicity(docs.union(docs.limit(3)), labels(spark, marks)).collect()
    assert len(scored) == 603
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in scored]) > 0.98
    assert toxicity.toxicity(docs.limit(0), labels(spark, marks)).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels(spark, [])).collect()} == {0.0}
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in scored[:600])


def test_toxicity_learns_from_whole_texts(spark):
    fill = [f"w{chr(97 + n)}{chr(97 + m)}" for n in range(20) for m in range(20)]
    rng = random.Random(6)
    rows, marks = [], []
    for n, doc_id in enumerate(ids_where(toxicity.MODULUS, {1, 2, 3, 4}, 300)):
        words = rng.choices(fill, k=30)
        if n % 6 == 0:
            words[2] = "vorpal" + rng.choice(["s", "ed", "ing", ""])
        if n % 6 == 1:
            words[2:4] = ["vorpal", "sword"]
        if n == 0:  # behind 300 other matches
            words = ["vorpals", "xx"] * 300 + ["vorpal", "sword"]
        rows.append((doc_id, " ".join(words), None))
        marks.append((doc_id, 1, int(n % 6 == 0)))
    model = toxicity.train(table(spark, rows), labels(spark, marks))
    assert "vorpal" in model.weights
    assert "vorpal sword" not in model.exceptions
    raw, label = toxicity._raw_scores(table(spark, rows).select("text", "label"), model)
    machine = model.automaton()
    wanted = sorted(toxicity.raw_score(toxicity.fold(t), model, machine) for _, t, _ in rows)
    assert sorted(raw) == wanted and len(label) == len(rows)


def test_toxicity_keeps_all_terms(spark):
    """Thousands of terms that are toxic in more documents and weigh more take no place of a late one."""
    rng = random.Random(9)
    letters = "bcdfghjklmnpqrstvwxz"
    many = sorted({"".join(rng.choices(letters, k=5)) for _ in range(6_300)})[:6_000]
    rows = [(" ".join(many), 1)] * 60 + [("zzzyy", 1)] * 40 + [("zzzyy", 0)] * 5 + [("fill", 0)] * 900
    sample = spark.createDataFrame(rows, "text string, label int")
    weights = toxicity.lexicon(sample, 100, 905)
    assert len(weights) > 5_000 and any("zzzyy".startswith(t) for t in weights)


def test_matches_equal_a_plain_search():
    """The automaton against every term at every place; neighbours are whole words at any distance."""
    rng = random.Random(8)
    terms = ["abc", "abcd", "bca", "cab", "ccc"]
    machine = toxicity.Model(dict.fromkeys(terms, 1.0)).automaton()
    texts = ["".join(rng.choices("abcd  .1", k=rng.choice([0, 5, 60, 200]))) for _ in range(300)]
    texts += ["n" * 60 + " abc " + "m" * 60, "far" + " " * 500 + "abc" + "." * 500 + "off", "abc", "x abcabc"]
    for text in texts:
        want = []
        for start in range(len(text)):
            here = [t for t in terms if text.startswith(t, start)]
            if here and (start == 0 or not text[start - 1].isalpha()):
                end = start
                while end < len(text) and text[end].isalpha():
                    end += 1
                runs = "".join(c if c.isalpha() else " " for c in text)
                before, after = runs[:start].split(), runs[end:].split()
                want.append(
                    (max(here, key=len), f"{before[-1] if before else ''} {text[start:end]}",
                     f"{text[start:end]} {after[0] if after else ''}")
                )
        assert sorted(toxicity.matches(text, machine)) == sorted(want), text


def test_sample_counts_rows_not_ids(spark):
    """Thousands of rows under one labelled id keep to the bound; equal rows count once."""
    one = ids_where(15, {1, 2, 4}, 1)[0]
    rows = [(one, f"text {n}", None) for n in range(5_000)] + [(one, "again", None)] * 3_000
    shelf = Shelf(spark)
    marks = labels(spark, [(one, 1, 1), (one, 0, 0)])
    args = (table(spark, rows), marks, "toxic", 5, zlib.crc32(str(one).encode()) % 5 + 1)
    sample = labelled_sample(*args, 40, shelf).collect()
    assert len(sample) == 40 and {r["label"] for r in sample} == {1}
    assert len(labelled_sample(*args, 9_000, shelf).collect()) == 5_001
    shelf.close()


def test_quality_learns_every_passage(spark):
    """What tells the kinds apart stands in passage 300 alone; and the score equals a plain loop's."""
    rng = random.Random(12)
    words = [a + b for a in "bcdfg" for b in ("ale", "ore", "und", "ist")]
    ids = ids_where(quality.MODULUS, {0, 2}, 60)
    rows, marks = [], []
    for n, doc_id in enumerate(ids):
        parts = [" ".join(rng.choices(words, k=quality.PASSAGE_WORDS)) for _ in range(302)]
        if n % 2:
            parts[299] = " ".join(["%%%9999%%%"] * quality.PASSAGE_WORDS)
        rows.append((doc_id, " ".join(parts), None))
        marks.append((doc_id, int(not n % 2), 0))
    docs, marked = table(spark, rows), labels(spark, marks)
    model = quality.train(docs, marked)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert np.mean([got[i]["predicted"] == q for i, q, _ in marks]) > 0.95
    for doc_id, text, _ in rows[:4]:
        features, _ = quality.passages([text.encode()])
        hidden = [np.tanh((f - model["mean"]) / model["spread"] @ model["W"] + model["b"]) for f in features]
        raw = [
            sum(model["w"] * np.tanh(h @ model["V"]) / (1 + np.exp(-(h @ model["U"])))) for h in hidden
        ]
        share = np.exp(np.array(raw) - max(raw))
        z = sum(a * h for a, h in zip(share / share.sum(), hidden, strict=True))
        want = 1 / (1 + math.exp(-float(z @ model["c"] + model["d"])))
        assert got[doc_id]["score"] == pytest.approx(want, abs=1e-3)
    few = quality.train(docs, marked, most=302 * 10)
    assert few.keys() == model.keys() and not np.array_equal(few["W"], model["W"])
    assert quality.train(docs, marked, most=10) == quality.constant(1.0)


def test_toxicity_terms_in_few_documents(spark):
    rows = [(f"zz{chr(97 + n % 10)} vor", 1) for n in range(100)] + [("vor", 0)] * 20 + [("fill", 0)] * 980
    sample = spark.createDataFrame(rows, "text string, label int")
    assert "vor" in toxicity.lexicon(sample, 100, 1000)


def test_sample_is_drawn_from_the_given_documents(spark):
    """Labels of documents that are not there change nothing, however many."""
    ids = ids_where(15, set(range(15)), 4_000)
    rows = [(i, "vorpal word" if i % 2 else "other word", None) for i in ids[:400]]
    there = [(i, i % 2, i % 2) for i in ids[:400]]
    away = [(i, 1, 0) for i in ids[400:]]
    docs = table(spark, rows)
    marks, more = labels(spark, there), labels(spark, there + away)
    assert toxicity.train(docs, more, 100) == toxicity.train(docs, marks, 100)
    one, other = quality.train(docs, more, 100), quality.train(docs, marks, 100)
    assert all(np.array_equal(one[k], other[k]) for k in other)
    assert toxicity.train(docs, labels(spark, away)).offset == -math.inf


def test_fold():
    assert toxicity.fold("ІDІ0T") == "idiot"
    assert toxicity.fold("ｉｄｉｏｔ i​diot М0R0N") == "idiot idiot moron"


def test_language_edges(spark):
    learn = ids_where(3, {0, 2}, 40)
    rows = [(i, "the house and the river" if n % 2 else "das haus und der fluss", "en" if n % 2 else "de") for n, i in enumerate(learn)]
    rows += [(5000, None, "en"), (5001, "", "en"), (5002, "123 !? \n", None), (5003, "DAS HAUS", None), (None, "the river", None)]
    rows += [(5004, "the house " * 20_000, None), (5003, "DAS HAUS", None)]
    docs = table(spark, rows)
    got = language_id.language_id(docs).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(rows)
    assert [by[n] for n in (5000, 5001, 5002)] == [("und", 0.0)] * 3
    assert [by[n][0] for n in (5003, None, 5004)] == ["de", "en", "en"]
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = language_id.language_id(docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("false"))
    assert nothing.count() == 0
    unknown = language_id.identify(docs, language_id.train(docs.filter("lang IS NULL"))).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}


def test_language_scores_by_hand():
    """Brute force: probabilities from plain counting of n-grams over the same bins."""
    texts = {"en": ["the cat", "a cat"], "de": ["die katze", "eine"]}
    names = sorted(texts)
    logs = np.zeros((language_id.BINS, 2))
    for n, name in enumerate(names):
        counts = np.zeros(language_id.BINS)
        for t in texts[name]:
            for b in language_id.gram_bins([t.encode()])[0]:
                counts[b] += 1
        logs[:, n] = np.log((counts + 0.5) / (counts + 0.5).sum())
    prior = np.log([0.5, 0.5])
    wanted = prior + sum(logs[b] for b in language_id.gram_bins([b"cats"])[0])
    share = np.exp(wanted - wanted.max())
    labels_, scores = language_id.score_texts([b"cats", b"--"], names, logs.astype(np.float32), prior)
    assert labels_ == [names[int(share.argmax())], "und"]
    assert scores.tolist() == pytest.approx([share.max() / share.sum(), 0.0], rel=1e-4)


def test_gram_bins_stay_inside_texts():
    together = language_id.gram_bins([b"ab cd", b"", b"efg"])
    alone = [language_id.gram_bins([t])[0] for t in (b"ab cd", b"", b"efg")]
    for owner, found in enumerate(alone):
        assert sorted(together[0][together[1] == owner]) == sorted(found)
    assert together[2].tolist() == [True, False, True]


def test_pipeline(spark):
    """Each stage against what its operator decides on the same input."""
    docs = documents(spark, SMALL)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        assert out.columns == columns and Counter(rows) - Counter(before) == Counter()
        if name == "quality_classifier":
            model = quality.train(docs, registry.labels(spark, SMALL))
            keep = {r["doc_id"] for r in quality.score(docs, model).filter("predicted = 1").collect()}
        elif name == "toxicity":
            model = toxicity.train(docs, registry.labels(spark, SMALL))
            keep = {r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
        elif name == "exact_dedup":
            keep = {r["doc_id"] for r in exact_dedup.exact_dedup(docs).filter("kept").collect()}
        else:
            found = jaccard_join.jaccard_components(docs).filter("doc_id = component_id")
            keep = {r["doc_id"] for r in found.collect()}
        assert {r["doc_id"] for r in rows} == keep and len(rows) == len(keep)
        docs = spark.createDataFrame(rows, out.schema)
    packed = corpus_pipeline.run(spark, SMALL)
    wanted = packing.token_pieces(docs).collect()
    assert Counter(tuple(r)[:5] for r in packed.collect()) == Counter(tuple(r) for r in wanted)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier",
        "toxicity",
        "exact_dedup",
        "ngram_jaccard_join",
        "best_fit_packing",
    ]


def test_pipeline_on_a_dirty_table(spark, tmp_path):
    """Nulls in any column, repeated rows, equal ids, empty and long texts, columns named like ours; and no rows."""
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, _node int, _id int, _row int, key int, label int, node int, digest int"
    rng = random.Random(21)
    fill = [a + b for a in "bcdfgh" for b in ("ale", "ore", "und", "ist", "ent")]
    texts = [" ".join(rng.choices(fill, k=rng.choice([3, 40, 200]))) + "." for _ in range(60)]
    rows = [(n, t, "en", "s", len(t)) for n, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s", 1), (5, texts[5], "en", "s", 1), (6, "other words under the same id", "en", "s", 1)]
    rows += [(None, texts[7].upper(), None, None, None), (None, None, None, None, None), (200, "", "en", "s", 0)]
    rows += [(201, " ".join(f"w{n}" for n in range(30_000)), "en", "s", 1)]
    near = texts[8].split()
    rows += [(202, " ".join([*near, "again"]), "en", "s", 1)]
    extra = (1, 2, 3, 4, 5, 6, 7)
    docs = spark.createDataFrame([(*r, *extra) for r in rows], kind).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(n, 1, 0) for n in range(60)] + [(None, 1, 1), (3, None, None)]
    labels(spark, marks).write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} <= {r[0] for r in rows}
    assert {r["doc_id"] for r in packed} >= set(range(10, 60)) | {200, 201}
    assert 202 not in {r["doc_id"] for r in packed} or len(near) < 30
    empty = f"{tmp_path}/none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels(spark, []).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_registered_queries(spark):
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{n}" for n in range(1, 14)]
    assert names[-1] == "pipeline" and set(registry.oracles()) <= set(names)
