"""The corpus pipeline, stage by stage."""

import collections
import hashlib
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from reference import LOWER, fingerprint, roots
from test_operators import duplicates, library


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_each_stage_works_on_what_the_one_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, left = docs.columns, {}
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        docs = corpus_pipeline.written(stages[name](spark, docs, sf), "test")
        assert docs.columns == names
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    poor = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    rated = left["quality classifier"]
    assert not poor & set(rated)
    distinct = {min(ids) for ids in duplicates(rated.items()).values()}
    assert set(left["exact dedup"]) == distinct
    sets = {i: shingles(t, 5) for i, t in left["exact dedup"].items()}
    root = roots(sorted(sets), lambda a, b: not (sets[a] | sets[b]) or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    assert set(left["SimHash near-dedup"]) == set(root.values())
    assert left["mixing sources to target weights"] == left["SimHash near-dedup"]
    tok = library("word_bpe_49k.json")
    out = {r["doc_id"]: r["ids_sha256"] for r in stages["BPE encoding and decoding"](spark, docs, sf).collect()}
    assert out == {i: hashlib.sha256(np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in left["SimHash near-dedup"].items()}


def test_the_result_keeps_the_mixture(spark, sf):
    """The last stage's positions put the documents into the order in which the stage before left them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3 + F.col("doc_id") % 2))
    ordered = corpus_pipeline.written(corpus_pipeline.mix_sources(spark, docs, sf).coalesce(1), "test")
    out = corpus_pipeline.encode_tokens(spark, ordered, sf).collect()
    assert [r["doc_id"] for r in out] == [r["doc_id"] for r in ordered.collect()]
    positions = [r["position"] for r in out]
    assert positions == sorted(set(positions)) and len(out) == docs.count()


def test_near_copies_go_from_jaccard_0_8_on(spark, odd, sf):
    """Against all pairs of the texts, on the given table and on one large group whose copies differ in several places."""
    draw = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    swapped = [[w if j not in at else f"x{i}" for j, w in enumerate(base)] for i, at in enumerate(draw.choice(120, (150, 2)).tolist())]
    made = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(swapped)], "doc_id long, text string")
    for docs, apart in ((spark.read.parquet(f"{sf}/documents.parquet"), True), (made, True), (odd, False)):
        texts = collections.defaultdict(list)
        for r in docs.collect():
            if r["doc_id"] is not None:
                texts[r["doc_id"]] = shingles(r["text"], 5)
        alike = lambda a, b: not (texts[a] | texts[b]) or len(texts[a] & texts[b]) / len(texts[a] | texts[b]) >= 0.8
        root = roots(sorted(texts), alike)
        left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} - {None}
        assert left == set(root.values())
        if apart:  # the case that three bits do not find
            prints = {r["doc_id"]: fingerprint(r["text"], 5) for r in docs.collect()}
            assert any(i != j and (prints[i] ^ prints[j]).bit_count() > 3 for i, j in root.items())


def test_stages_take_odd_rows(spark, odd, empty, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
        out = stage(spark, odd, sf)
        if name != "BPE encoding and decoding":
            assert out.columns == odd.columns
        out.count()
