import hashlib
import os
import random
import re
import string

import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinledger.llm import mixing, queries, toxicity

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents (one extra column) and labels: toxic ones, copies, near copies, awkward rows."""
    pick, texts, toxic = random.Random(3), [], {}
    vocabulary = ["".join(pick.choice("aeioulnrst") for _ in range(pick.randrange(3, 8))) for _ in range(300)]
    for i in range(260):
        words = pick.choices(vocabulary, k=pick.choice([6, 40, 120]))
        if i % 5 == 0:
            words[pick.randrange(len(words))] = "wretch" + pick.choice(["", "ed", "es"])
        toxic[i] = int(i % 5 == 0)
        texts.append(" ".join(words))
    for i in range(1, 100, 7):
        texts += [texts[i].replace(" ", "\n\t", 3), texts[i] + " tail" if len(texts[i]) > 150 else texts[i]]
    rows = [(i, t, f"s{i % 3}", i) for i, t in enumerate(texts)] + [(5000, None, None, 1), (5001, "", "s0", 1), (5002, " \t", None, 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, size long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def near_kept(rows, words=5):
    sets = []
    for r in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOWER))
        n = min(words, len(found))
        sets.append({tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if found else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {rows[i]["doc_id"] for i in range(len(rows)) if label[i] == i}


def test_stages_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "near dedup", "source mixing", "subword encoding"]

    clean = stages["toxicity"](spark, docs, corpus)
    scores = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))).collect()
    got = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and got == {r["doc_id"] for r in scores if r["score"] < 0.3}
    wretched = {r["doc_id"] for r in docs.collect() if "wretch" in (r["text"] or "")}
    assert len(got & wretched) <= 0.1 * len(wretched) and len(got) >= 0.95 * (docs.count() - len(wretched))

    single = stages["exact dedup"](spark, clean, corpus)
    first = {}
    for r in clean.orderBy("doc_id").collect():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == sorted(first.values())

    apart = stages["near dedup"](spark, single, corpus)
    assert apart.columns == docs.columns
    assert {r["doc_id"] for r in apart.collect()} == near_kept(single.orderBy("doc_id").collect())

    mixed = stages["source mixing"](spark, apart, corpus)
    times = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) if r["size"] else 0 for r in mixing.taken(*mixing.mix(apart)).collect()}
    found = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and found == {d: n for d, n in times.items() if n}

    final = stages["subword encoding"](spark, mixed, corpus).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(final) == sum(found.values())
    assert all(r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == 2 * r["n_pieces"] for r in final)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, corpus).collect()) == sorted(tuple(r) for r in final)


def test_stages_on_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(FOLDER), FOLDER, queries.QUERIES[name], queries.SQL[name]) == ""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_queries_give_a_row_per_document(spark, name):
    ids = [r["doc_id"] for r in queries.QUERIES[name](spark, FOLDER).select("doc_id").collect()]
    assert sorted(ids) == [r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").orderBy("doc_id").collect()]
