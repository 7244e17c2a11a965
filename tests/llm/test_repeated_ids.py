"""Ids that come with several contents, and surrogates on crowded forms."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventlens.llm import multiindex, oddsketch, surrogates


def text(letter, change=None):
    words = [f"{letter}{k}" for k in range(80)]
    if change is not None:
        words[change] = "other"
    return " ".join(words)


def test_each_text_of_an_id_keeps_its_links(spark):
    rows = [(5, text("a")), (5, text("b")), (6, text("a", 3)), (7, text("b", 79)), (8, text("c")), (None, text("a"))]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect())
    assert got == [("5", 5, True), ("5", 5, True), ("6", 5, False), ("7", 5, False), ("8", 8, True), ("None", None, True)]


def test_each_vector_of_an_id_keeps_its_links(spark):
    e = np.eye(8)
    rows = [(5, e[0].tolist()), (5, e[1].tolist()), (6, (e[0] + 0.05 * e[2]).tolist()), (7, (e[1] + 0.05 * e[3]).tolist()), (9, e[4].tolist())]
    got = sorted(tuple(r) for r in multiindex.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))).select("vec_id", "n_links", "component_id").collect())
    assert got == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (9, 0, 9)]


def test_recall_on_a_real_grid(spark):
    """4000 vectors of one label have a grid of several cells a side; links against all cosines."""
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(1300, 16)), 3, axis=0)
    v += rng.normal(scale=0.08, size=v.shape)
    table = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = np.array([r.n_links for r in multiindex.linked(table).orderBy("vec_id").collect()])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert (got == (u @ u.T >= 0.98).sum(axis=1) - 1).all() and got.sum() > 3000


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rows = [(5, text("a"), "x"), (5, text("b"), "y"), (6, text("a", 3), "z"), (None, text("c"), "n"), (None, text("c"), "n"), (2, text("b"), "w"), (3, "", "e"), (4, None, "e"), (4, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumns({"doc": F.lit(1), "component_id": F.lit(2)})
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.row) for r in out.collect()) == [("2", "w"), ("3", "e"), ("4", "e"), ("4", "e"), ("5", "x"), ("None", "n")]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_crowded_forms_get_distinct_surrogates(spark):
    """More family names than four letters of a form could tell apart, and short forms of digits."""
    names = spark.range(3000).selectExpr("id AS doc_id", "concat('Herr ', initcap(concat(char(97 + id % 26), char(97 + id div 26 % 26), char(97 + id div 676))), ' came.') AS text")
    phones = spark.range(4000).selectExpr("id + 5000 AS doc_id", "concat('call (12) 000-', lpad(cast(id AS string), 4, '0'), '!') AS text")
    docs = names.union(phones)
    got = {r.doc_id: r.text for r in surrogates.replaced(docs).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    hit = re.compile(r"Herr \S+|\([\d]+\) \d{3}-\d+")
    made = {i: hit.search(x).group() for i, x in got.items()}
    old = {i: hit.search(x).group() for i, x in before.items()}
    assert len(set(made.values())) == len(set(old.values())) and not set(made.values()) & set(old.values())
    other = {r.doc_id: r.text for r in surrogates.replaced(docs, key="another").collect()}
    assert sum(other[i] != got[i] for i in got) > 6000


def test_marks_in_texts_and_clashing_columns(spark):
    rows = [(1, f"a{surrogates.MARK}b 10.1.2.3 c{surrogates.MARK}", "p"), (2, "no entity", "q"), (3, "call +1 555 123 4567 and 10.1.2.3 or 10.1.2.3", "r"), (4, None, "s"), (5, "x 10.1.2.3 " * 3000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts string").withColumns({"n_entities": F.lit("x"), "row": F.lit(1), "doc": F.lit(2), "by": F.lit(3), "_parts": F.lit(4)})
    out = surrogates.replaced(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [c for c in docs.columns if c != "n_entities"] + ["n_entities"]
    ip = re.search(r"b (\S+) c", got[1].text).group(1)
    assert got[1].text == f"a{surrogates.MARK}b {ip} c{surrogates.MARK}" and got[3].text.count(ip) == 2 and got[5].text == f"x {ip} " * 3000
    assert [got[k].n_entities for k in (1, 2, 3, 4, 5)] == [1, 0, 3, 0, 3000] and got[4].text is None and got[2].text == "no entity"


@pytest.mark.parametrize("word", ["aaa@bbb.org", "a.b@c.d.co", "x10.1.2.3@mail.com", "10.1.2.3 and 4111 1111 1111 1111 or DE44 5001 0517 5407 3249 31."])
def test_detection_is_that_of_the_plain_patterns(spark, word):
    plain = re.sub(r"\(\?:\(\?<!\[A-Za-z0-9\._%\+-\]\)\|\\G\)\[A-Za-z0-9\._%\+-\]\+\+", "[A-Za-z0-9._%+-]+", surrogates.ANY)
    assert plain != surrogates.ANY
    docs = spark.createDataFrame([(1, f"{word} then {word},{word}")], "doc_id long, text string")
    got = surrogates.detected(docs).selectExpr("filter(_parts, (x, i) -> i % 2 = 1) AS h", f"regexp_extract_all(text, {surrogates._quoted(plain)}, 0) AS w").first()
    assert got.h == got.w and len(got.h) >= 3
