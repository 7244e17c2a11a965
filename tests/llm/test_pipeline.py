"""The stages of the pipeline, each on its own input, against what they have to decide, with odd rows and clashing columns."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eventlens.llm import langid, secrets, toxicity
from eventlens.llm.queries import TOKENIZER

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
CLASH = ["_text", "_lang", "_score", "_toxic", "_spans", "_base", "n_entities", "doc", "row", "component_id", "length", "start", "o"]
KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
COPY = "one and the same text that is long enough to have some shingles of five words in it"


def texts(docs):
    return Counter((r.doc_id, r.text) for r in docs.collect())


@pytest.fixture(scope="module")
def docs(spark):
    """Documents and odd rows, with columns named like those the stages work with."""
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(1, None), (1, ""), (2, "12 !!"), (3, COPY), (3, COPY), (4, COPY), (3, "an other text under an id that was given before, with words of its own"), (None, COPY), (None, f"token = {KEY} of the day"),
           (5, "word " * 20_000)]
    rows = spark.createDataFrame(odd, "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 10_000_000)
    both = whole.unionByName(rows, allowMissingColumns=True)
    return both.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def test_language_stage_drops_what_it_rejects(spark, docs):
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("_lang").distinct().collect()} == {"own _lang"}
    found = langid.identify(docs, langid.prototypes(docs.where(~langid.held_out())), ("doc_id", "text")).collect()
    assert texts(kept) == Counter((r.doc_id, r.text) for r in found if r._lang != "und" and r._score >= 0.05)
    assert not any(text is None or not re.search(r"[^\W\d_]", text) for _, text in texts(kept))


def test_toxicity_stage_drops_what_it_rejects(spark, docs):
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("_toxic").distinct().collect()} == {"own _toxic"}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    assert texts(kept) == Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if model.score(r.text or "") < 0.7)


def test_near_dedup_stage_keeps_one_of_each_group(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, group = [shingles(x) for _, x in rows], list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for k, a in enumerate(sets):
        for j in range(k):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group[root(k)] = root(j)
    members = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[root(k)].append((i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == sorted(min(m) for m in members.values())


def test_secrets_stage_masks_and_keeps_every_row(spark, docs):
    out = corpus_pipeline.secrets(spark, docs, SF)
    assert out.columns == docs.columns and {r[0] for r in out.select("_spans").distinct().collect()} == {"own _spans"}
    assert out.count() == docs.count() and not any(KEY in (text or "") for _, text in texts(out))
    spans = Counter((r.doc_id, r.spans == "") for r in secrets.report(docs).collect())
    same = texts(docs) & texts(out)
    assert sum(same.values()) >= sum(n for (_, clean), n in spans.items() if clean)
    assert out.where("text IS NOT NULL AND n_chars IS NOT NULL").where("n_chars <> char_length(text) AND text LIKE '%[secret]%'").isEmpty()


def test_packing_stage_places_every_token(spark, docs):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path(TOKENIZER))
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    assert sum(r.length for r in pieces) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    filled = defaultdict(list)
    for r in pieces:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_of_an_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
