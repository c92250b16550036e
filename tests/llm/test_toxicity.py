"""The factorization machine: learned pairs, held-out accuracy, scores by a plain sum over all pairs of terms, and odd rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from frameline.llm.common import doc_mod
from frameline.llm.toxicity import chosen_labels, fit_machine, score_toxicity, terms_of

WORDS = "river stone letter winter garden market teacher window mountain engine picture question answer valley".split()


def texts(n: int, seed: int) -> list[tuple[int, str, int]]:
    """Toxic where an insult and a group are both named; either alone is harmless, and so is every other word."""
    chance, rows = random.Random(seed), []
    for k in range(n):
        words = [chance.choice(WORDS) for _ in range(chance.randint(5, 30))]
        insult, group = chance.random() < 0.5, chance.random() < 0.5
        words += ["zounderish"] * insult + ["quibblers"] * group
        chance.shuffle(words)
        rows.append((k, " ".join(words), int(insult and group)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = texts(1200, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = fit_machine(docs, "doc_id", "text", docs.filter("doc_id % 4 <> 0").select("doc_id", "toxic"), "toxic")
    return docs, machine


def test_a_pair_counts_for_what_neither_term_says(spark, learned):
    docs, machine = learned
    got = score_toxicity(docs.filter("doc_id % 4 = 0"), "text", machine, ["doc_id", "toxic"]).collect()
    assert all(r["predicted"] == r["toxic"] for r in got) and len(got) == 300
    alone = spark.createDataFrame([(1, "a zounderish river"), (2, "quibblers in winter"), (3, "zounderish quibblers"), (4, "nothing of it")], "doc_id long, text string")
    assert [r["predicted"] for r in score_toxicity(alone, "text", machine, ["doc_id"]).orderBy("doc_id").collect()] == [0, 0, 1, 0]


def test_scores_equal_the_sum_over_all_pairs(spark, learned):
    _, machine = learned
    odd = ["a zounderish river", "Quibblers ZOUNDERISH quibblers", "x" * 50_000, "zounderish quibblers " * 20_000, "", " \n\t", None, "ÀÉ ß zounderisher", "\U0001f600 zounder"]
    place = {int(t): k for k, t in enumerate(machine.terms)}
    got = {r["k"]: r["score"] for r in score_toxicity(spark.createDataFrame(list(enumerate(odd)), "k int, text string"), "text", machine, ["k"]).collect()}
    for k, text in enumerate(odd):
        ids = sorted({place[t] for w in (text or "").lower().split() for t in terms_of(w) if t in place})
        z = machine.bias + sum(machine.weights[i] for i in ids) + sum(float(machine.vectors[i] @ machine.vectors[j]) for n, i in enumerate(ids) for j in ids[n + 1 :])
        assert got[k] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), rel=1e-9)
    assert got[4] == got[5] == got[6]


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    machine = fit_machine(docs, "doc_id", "text", labels.filter(doc_mod("doc_id", 5) != 0), "toxic")
    held = docs.join(labels.filter(doc_mod("doc_id", 5) == 0), "doc_id")
    got = score_toxicity(held, "text", machine, ["doc_id", "toxic"]).collect()
    found = sum(r["toxic"] == 1 and r["predicted"] == 1 for r in got)
    assert sum(r["toxic"] == 0 and r["predicted"] == 1 for r in got) == 0, "clean documents are left alone"
    assert found >= 0.8 * sum(r["toxic"] == 1 for r in got)  # 10,000 documents name some of the insults a handful of times


def test_labels_that_are_taken(spark):
    rows = [(k, int(k % 10 == 0)) for k in range(5000)] + [(7, 0)] * 50 + [(None, 1), (8, None), (9, 1)]
    chosen = chosen_labels(spark.createDataFrame(rows, "doc_id long, toxic int"), "doc_id", "toxic", most=1000).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()
    by = {r["label"]: r for r in chosen}
    assert by[1]["n"] == by[1]["w"] == 501 and 850 < by[0]["n"] < 1150 and by[0]["w"] == pytest.approx(4500 * by[0]["n"] / 1000)


def test_few_labels_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "kept", 3), (1, "a", "kept", 3), (None, "b", None, None)], "doc_id long, text string, score string, predicted int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    machine = fit_machine(docs, "doc_id", "text", none, "toxic")
    out = score_toxicity(docs, "text", machine, ["doc_id", "score", "predicted"])
    assert out.columns == ["doc_id", "score_kept", "predicted_kept", "score", "predicted"]
    assert sorted((r["doc_id"] or 0, r["score_kept"] or "", round(r["score"], 9), r["predicted"]) for r in out.collect()) == [(0, "", 0.25, 0), (1, "kept", 0.25, 0), (1, "kept", 0.25, 0)]
    assert score_toxicity(docs.limit(0), "text", machine, ["doc_id"]).count() == 0
    one_sided = fit_machine(docs, "doc_id", "text", spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), "toxic")
    assert len(one_sided.terms) == 0
