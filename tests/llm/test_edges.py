"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import random

import numpy as np
import pytest

from tablekin.llm import embedding_dedup, html_extraction, jaccard_join, packing, quality_classifier, quality_rules, secret_scan, source_mixing, token_output, toxicity
from tablekin.llm.common import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", score double, kept string, component_id string, task int, rank int, _copy int, _source string, rep string, length string"


def rows():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    some = " ".join(rng.choice(words) for _ in range(80))
    texts = [None, "", " \n\t ", "one", "one two three four", some, some, some + " end", long, "x" * 50_000, "a\n" * 3000, "\x00\x01 é😀  ", "%41" * 2000]
    out = [(k, t, "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*out, out[5], (None, some, None, None, None), (None, some, None, None, None), (99, None, None, None, None)]


def with_extra(data):
    return [(*r, 0.5, "no", "c", 1, 2, 3, "z", "r", "l") for r in data]


def labelled(docs):
    return toxicity.train(["you are a vile grub", "fine words here", "vile grub again", "more fine words"] * 5, [1, 0, 1, 0] * 5)


OPERATORS = {
    "token_output": None,
    "jaccard_join": jaccard_join.jaccard_join,
    "near_copies": jaccard_join.without_near_copies,
    "packing": packing.packed,
    "source_mixing": source_mixing.source_mixing,
    "secret_scan": secret_scan.secret_scan,
    "redact": secret_scan.redact,
    "quality_rules": quality_rules.quality_rules,
    "quality": lambda d: quality_classifier.quality(d, quality_classifier.train(["good words"] * 9 + ["BAD!! WORDS!!"] * 9, [1] * 9 + [0] * 9, epochs=3)),
    "toxicity": lambda d: toxicity.toxicity(d, labelled(d)),
    "without_toxic": lambda d: toxicity.without_toxic(d, labelled(d)),
}


def token_round(spark, docs):
    folder = shared_folder(spark)
    token_output.write(docs, folder)
    return token_output.token_ids(spark, folder)


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("kind", ["odd", "extra", "empty"])
def test_documents(spark, name, kind):
    data = rows()
    docs = spark.createDataFrame([] if kind == "empty" else with_extra(data) if kind == "extra" else data, EXTRA if kind == "extra" else SCHEMA)
    got = (token_round(spark, docs) if name == "token_output" else OPERATORS[name](docs)).collect()
    if kind == "empty":
        assert got == []
    elif name in ("token_output", "jaccard_join", "secret_scan", "redact", "quality_rules", "quality", "toxicity"):
        assert len(got) == len(data)
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in data)
    if kind == "odd" and name == "near_copies":
        # 5, 6 and the repeated 5 are one text and 7 is a near copy of it; a null id can't be judged
        assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 99]
        assert sum(r["doc_id"] is None for r in got) == 2
    if kind == "odd" and name == "jaccard_join":
        by = {r["doc_id"]: r for r in got}
        assert by[None]["component_id"] is None and by[None]["kept"]
        assert by[0]["n_links"] == by[1]["n_links"] == by[2]["n_links"] == 0
        assert by[5]["class_id"] == by[6]["class_id"] == 5 and by[7]["component_id"] == 5
        assert by[6]["n_links"] == 3 and by[7]["n_links"] == 3  # 5 counts twice, as it comes twice


def test_packing_of_odd_rows(spark):
    got = packing.packed(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows()}
    assert all(r["length"] == 1 for r in got if r["doc_id"] in (0, 1, 2, 99))


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, nan]), (8, [inf, 0.0]), (9, [1.0, None]), (10, [1.0, 0.0, 0.0]), (11, [0.0, -1.0]), (None, [1.0, 0.0]), (12, [1e300, 1e300]), (13, [1e-300, 1e-300])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 as kept", "2 as raw", "3 as n_links")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(frame).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    for k in (4, 5, 6, 7, 8, 9, 10, 11):
        assert got[k] == (0, k, True)
    assert got[None] == (0, None, True)
    assert got[12] == (1, 12, True) and got[13] == (1, 12, False)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_dedup(empty).collect() == []


def test_pages(spark):
    data = [(1, None, None), (2, "u", ""), (3, "u", "<p>a<p>b"), (3, "u", "<p>a<p>b"), (None, None, "<div>" * 5000 + "deep"), (4, "u", "plain & simple &amp; <")]
    frame = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as title")
    got = html_extraction.html_extraction(frame).collect()
    assert len(got) == len(data)
    assert sorted(r["text"] for r in got if r["page_id"] == 3) == ["a\n\nb", "a\n\nb"]
    assert [r["text"] for r in got if r["page_id"] is None] == ["deep"]
    assert html_extraction.html_extraction(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_one_class_of_labels():
    assert toxicity.train(["a b"], [0]).scores(["x", None]).tolist() == [0.0, 0.0]
    assert toxicity.train([], []).scores([]).tolist() == []
    assert quality_classifier.Scorer(quality_classifier.train([], []))(["x"]) == [1.0]
    got = labelled(None).scores(["", None, "x" * 100_000, "same text", "same text"])
    assert np.isfinite(got).all() and got[0] == got[1] and got[3] == got[4]
