import random
import zlib

import numpy as np
import pytest

from twinledger.llm import language, quality, toxicity
from twinledger.llm.hashing import shingles, word_hashes
from twinledger.llm.ngrams import Linear, class_quotas


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_language_held_out(table, prose, awkward):
    rows = [(i, prose(lang, 60, i), lang, "s", 0, 0, "k", "h") for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    docs = table(rows + [(10_000 + k, *r[1:]) for k, r in enumerate(awkward)])
    model = language.train(docs.where("doc_id < 10000"), steps=150)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert held and all(got[r[0]]["held_out"] == (crc(r[0], 4) == 2) for r in rows)
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[10_000 + k]["lang_pred"] == "und" for k in range(4)] == [True, True, True, False]
    assert len(got) == len(rows) + len(awkward)


def test_language_whole_text_counts(table, prose):
    rows = [(i, prose(lang, 60, i), lang, "s", 0, 0, "k", "h") for i, lang in enumerate(["aa", "bb"] * 60)]
    model = language.train(table(rows), steps=150)
    names, _ = model.predict([prose("aa", 20, 1) + " " + prose("bb", 2000, 2), prose("bb", 20, 1) + " " + prose("aa", 2000, 2)])
    assert names == ["bb", "aa"]


def test_language_window_network_matches_direct_convolution():
    rng = np.random.default_rng(1)
    windows = rng.integers(1, 256, (40, language.WINDOW)).astype(np.uint8)
    net = language.fit(windows, np.arange(40) % 2, ["x", "y"], steps=3, batch=8)
    text = windows[0, : language.STEP].tobytes().decode("latin-1").encode()[: language.STEP]
    data = np.zeros(language.STEP, dtype=np.uint8)
    data[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    seen = net.embedding[np.concatenate([data, np.zeros(4, dtype=np.uint8)])]
    hidden = []
    for width, kernel, shift in zip(language.WIDTHS, net.filters, net.shifts):
        response = [seen[t : t + width].ravel() @ kernel for t in range(language.STEP)]
        hidden.append(np.maximum(np.max(response, axis=0) + shift, 0))
    logits = np.concatenate(hidden) @ net.dense + net.offset
    expected = np.exp(logits) / np.exp(logits).sum()
    got = net.window_probabilities(net.tables(), data)[0]
    assert np.allclose(got, expected, atol=1e-5)


def test_nothing_to_learn_from(table, spark):
    docs = table(["some text", None])
    assert language.train(docs.withColumn("lang", docs.lang.substr(9, 1)).where("false")) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        assert [r["score"] for r in module.score(docs, module.train(docs, labels)).collect()] == [0.5, 0.5]
        assert module.score(table([]), module.train(table([]), labels)).collect() == []


@pytest.mark.parametrize("module,label,parts,part", [(toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)])
def test_classifier_held_out(table, spark, prose, awkward, module, label, parts, part):
    pick = random.Random(2)
    texts, marks = [], []
    for i in range(500):
        words = prose("aa" if i % 2 else "cc", 80, i).split()
        bad = pick.random() < 0.3
        if bad and label == "toxic":
            words[pick.randrange(80)] = "wretched" + pick.choice(["", "ly", "est"])
        if bad and label == "quality":
            words = [w for w in words[:8] for _ in range(10)]
        texts.append(" ".join(words))
        marks.append(int(bad) if label == "toxic" else int(not bad))
    rows = [(i, t, None, None, 0, 0, "k", "h") for i, t in enumerate(texts)]
    docs = table(rows + [(10_000 + k, *r[1:]) for k, r in enumerate(awkward)])
    labels = spark.createDataFrame(
        [(i, m, m) for i, m in enumerate(marks)] + [(0, None, None), (None, 1, 1), (1, marks[1], marks[1])], "doc_id long, quality int, toxic int"
    )
    got = {r["doc_id"]: r for r in module.score(docs, module.train(docs, labels)).collect()}
    held = [i for i in range(500) if crc(i, parts) == part]
    assert held and all(got[i]["held_out"] == (i in set(held)) for i in range(500))
    assert sum(got[i]["predicted"] == marks[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert len(got) == 500 + len(awkward)
    again = {r["doc_id"]: r["score"] for r in module.score(docs, module.train(docs, labels)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


@pytest.mark.parametrize("module,parts,part", [(toxicity, 4, 2), (quality, 5, 0)])
def test_a_class_rarer_than_the_sample_is_learned(table, spark, prose, module, parts, part):
    learned = [i for i in range(400) if crc(i, parts) != part]
    rare = {*learned[50:250:50], next(i for i in range(400) if crc(i, parts) == part)}
    texts = [" ".join(["wretched wretchedly"] * 20) if i in rare else prose("aa", 60, i) for i in range(400)]
    docs = table([(i, t, None, None, 0, 0, "k", "h") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i in rare), int(i in rare)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = module.train(docs, labels, max_rows=20)
    scores = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    assert min(scores[i] for i in rare) > max(s for i, s in scores.items() if i not in rare)
    assert sum(scores.values()) / 400 < 0.1


def test_quotas_of_classes():
    assert class_quotas(np.array([2000, 3]), 3000).tolist() == [2000, 3]
    assert class_quotas(np.array([9_000_000, 3000]), 3000).tolist() == [2700, 300]
    assert class_quotas(np.array([7, 9_000_000]), 3000).tolist() == [7, 2993]
    assert class_quotas(np.array([87_000, 13_000]), 3000).tolist() == [2610, 390]
    assert class_quotas(np.array([1, 5]), 2).tolist() == [1, 1]


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(60)]
    labels = np.array([int(0 in r) for r in rows])
    weights, bias = quality.dual_coordinate_descent(labels, rows, np.ones(12), 1.0, 2000)
    x = np.array([[1 / 2 if j in r else 0 for j in range(12)] + [1] for r in rows])
    y = 2 * labels - 1

    def loss(w):
        return 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()

    best = np.append(weights, bias)
    assert all(loss(best) <= loss(best + rng.normal(scale=s, size=13)) + 0.02 for s in (0.001, 0.01, 0.1) for _ in range(100))


def test_ngrams_of_awkward_texts():
    for extract in (toxicity.character_ngrams, quality.word_ngrams):
        found = list(extract([None, "", " ", "a", "ab cd\x00e", "Äé\U0001f600"]))
        assert len(found) == 6 and all((f < 1 << 20).all() for f in found)
    model = Linear(np.full(1 << 20, -1, dtype=np.int32), np.zeros(1), 0.0)
    assert list(model.scores(toxicity.character_ngrams, [None, "x"])) == [0.5, 0.5]


def test_word_hashes_and_shingles():
    texts = ["a b  c\na", None, "", "A B c", "c" * 3_000_000 + " a", "x\x0by\x0cz", "a b c a " * 400_000]
    found = list(word_hashes(texts))
    single = {w: next(word_hashes([w]))[0] for w in ("a", "b", "c", "x", "y", "z")}
    assert list(found[0]) == [single[w] for w in "abca"]
    assert [len(f) for f in found[1:4]] == [0, 0, 3] and list(found[3]) == [single[w] for w in "abc"]
    assert len(found[4]) == 2 and found[4][1] == single["a"]
    assert list(found[5]) == [single[w] for w in "xyz"]
    assert len(found[6]) == 1_600_000 and set(found[6]) == {single["a"], single["b"], single["c"]}
    assert list(next(word_hashes(["A"], lower=False))) != [single["a"]]
    assert len(shingles(found[6], 2)) == 4 and len(shingles(found[0], 5)) == 1 and len(shingles(found[1], 2)) == 0
