"""Each operator against a plain version, and on nulls, empty tables, repeated rows and clashing names."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from reference import fingerprint, license_words, roots

from orrery.llm import bpe, exact_dedup, language, licenses, mixing, neighbours, quality, shared, simhash, token_files, toxicity
from orrery.llm.queries import QUERIES, SQL, tokenizer_path
from orrery.llm.shared import scratch

SPACES = r"[\x20\x09-\x0D]+"


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def little(ids):
    return np.array(ids, "<u4").tobytes()


# 1. Token files


def test_token_files_hold_the_librarys_ids(spark, odd):
    path, tok = scratch(spark, "test"), library("byte_bpe_50k.json")
    token_files.write_tokens(odd, tokenizer_path("byte_bpe_50k.json"), path)
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["at"])
    key = lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or "")
    want = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=key)
    assert [(r["doc_id"], r["ids"]) for r in rows] == [(i, tok.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in want]
    out = sorted(token_files.token_offsets(token_files.token_digests(token_files.read_tokens(spark, path))).collect(), key=lambda r: r["at"])
    starts = np.cumsum([0] + [len(r["ids"]) for r in rows])[:-1]
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in out] == [(s, len(r["ids"]), zlib.crc32(little(r["ids"]))) for s, r in zip(starts, rows)]
    assert [r["doc_id"] for r in token_files.read_tokens(spark, path, [7]).collect()] == [7]


def test_token_files_of_no_rows(spark, empty):
    path = scratch(spark, "test")
    token_files.write_tokens(empty, tokenizer_path("byte_bpe_50k.json"), path)
    assert token_files.token_offsets(token_files.token_digests(token_files.read_tokens(spark, path))).count() == 0


PARTS = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\x0b", " ", " ", "\x85", "a", "The", "'s", "'LL", "12", "é", "é", "İ", "ſ", "ß", "Σ", "日", "🙂", "_", ".", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "Ġ", "\x1c", "‍", "ÀÉ", "µ", "K"])


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), min_size=1, max_size=4))
def test_encoders_agree_with_the_library_on_odd_texts(texts):
    import pyarrow as pa

    tok, path = library("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.json")
    ends, ids = token_files._encoder(path).batch(pa.array(texts, pa.string()), 0)
    assert [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:])] == [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    tok, own = library("word_bpe_49k.json"), bpe._tokenizer(tokenizer_path("word_bpe_49k.json"))
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == (little(want), tok.decode(want, skip_special_tokens=False))


def test_token_files_are_skipped_by_ranges_and_bloom_filters(spark):
    docs = spark.range(0, 48_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    path = scratch(spark, "skipped")
    token_files.write_tokens(docs, tokenizer_path("byte_bpe_50k.json"), path)

    def read(wanted):
        rows = token_files.read_tokens(spark, path, wanted)
        found = len(rows.collect())
        return found, rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    found, seen = read([10])
    assert found == 1 and 0 < seen < 24_000
    assert read([11]) == (0, 0)  # within a range, but not in its filter


# 2. Nearest neighbours


def test_neighbours_recall_and_exact_scores(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(0, 1, (20, 16))
    x = centres[draw.integers(0, 20, 3000)] + draw.normal(0, 0.4, (3000, 16))
    x[::3] = x[0]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, v.tolist(), "k") for i, v in enumerate(x)], "vec_id long, embedding array<double>, home string")
    found = pd.DataFrame([r.asDict() for r in neighbours.search(df, F.col("vec_id") % 100 == 0).collect()])
    hits = 0
    for q in range(0, 3000, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(3000), far)) if i != q][:10]
        mine = found[found.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(mine.score, far[mine.vec_id])
        hits += len(set(mine.vec_id) & set(best))
    assert hits >= 0.9 * 300


def recall(spark, x, asked, k=10):
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    found = neighbours.search(df, F.col("vec_id").isin(asked), k).toPandas().groupby("query_id")["vec_id"].agg(set)
    hits = 0
    for q in asked:
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        hits += len(found[q] & set(np.lexsort((np.arange(len(x)), far))[:k].tolist()))
    print(f"recall {hits / (k * len(asked)):.3f}")
    return hits / (k * len(asked))


def test_neighbours_of_vectors_without_clusters(spark):
    x = np.random.default_rng(5).normal(0, 1, (10_000, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    assert recall(spark, x, list(range(0, 10_000, 100))) >= 0.9


def test_neighbours_of_the_given_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(neighbours.usable(F.col("embedding").cast("array<double>"))).toPandas()
    rows = rows[rows["embedding"].map(len) == rows["embedding"].map(len).mode()[0]].sort_values("vec_id")
    x, ids = np.stack(rows["embedding"].to_numpy()).astype(np.float64), rows["vec_id"].to_numpy()
    found = QUERIES["op2_neighbours"](spark, "/root/testdata/sf0.1").toPandas().groupby("query_id")["vec_id"].agg(set)
    hits, asked = 0, [i for i in range(len(ids)) if ids[i] % 100 == 0]
    for q in asked:
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        hits += len(found[ids[q]] & set(ids[np.lexsort((ids, far))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(asked)


def test_neighbours_within_thousands_of_near_copies(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(0, 1, (5000, 64))
    x[:3000] = x[0] + draw.normal(0, 0.002, (3000, 64))
    x[3000:4000] = x[4999] + draw.normal(0, 0.01, (1000, 64))
    assert recall(spark, x, list(range(0, 4000, 100))) >= 0.99


def test_neighbours_leave_out_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [4.0, 4.0]), (8, []), (None, [1.0, 1.0]), (100, [1.0, 4.0]), (200, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted(tuple(r) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).collect())
    assert out == [(0, 1, 1, 0.0), (0, 2, 100, 4.0), (0, 3, 7, 5.0), (100, 1, 7, 3.0), (100, 2, 0, 4.0), (100, 3, 1, 4.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# 3. Quality


def test_quality_on_rows_it_has_not_seen(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.95 * len(rows) > 50


def test_quality_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, None if i == 4 else i % 2) for i in range(0, 30)] + [(None, 1), (999, 0)], "doc_id long, quality int")
    out = quality.quality_scores(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert {r["score"] for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0


def test_isotonic_levels_never_fall():
    at, level = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 2, 1]), np.array([2.0, 2, 2, 2]))
    assert level.tolist() == [0.25, 0.75] and at.tolist() == [0.5, 2.5]


def test_quality_against_a_dense_fit(spark, sf):
    """The same features solved at once with numpy, and isotonic levels by their min-max formula."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(set(marks) & set(texts))
    x, y = np.array([quality.statistics(texts[i]) for i in ids]), np.array([float(marks[i]) for i in ids])
    model = quality.QualityModel(x.mean(0), np.maximum(x.std(0), 1e-3), 384, 6.0, 7)
    z = model.lift(x)
    weights = np.linalg.solve(z.T @ z + 1e-4 * len(z) * np.eye(z.shape[1]), z.T @ y)
    raw = z @ weights
    bins = np.clip((raw + 0.5) / 2 * 400, 0, 399).astype(int)
    at = np.array([raw[bins == b].mean() for b in np.unique(bins)])
    hits, n = (np.array([f(y[bins == b]) for b in np.unique(bins)], float) for f in (np.sum, len))
    level = [max(min(hits[j : k + 1].sum() / n[j : k + 1].sum() for k in range(i, len(n))) for j in range(i + 1)) for i in range(len(n))]
    pools = [[i for i in range(len(n)) if abs(level[i] - v) < 1e-12] for v in sorted(set(np.round(level, 12)))]
    places = [np.average(at[p], weights=n[p]) for p in pools if p]
    levels = [level[p[0]] for p in pools if p]
    found = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    for i, t in texts.items():
        want = np.interp(model.lift(quality.statistics(t)[None, :]) @ weights, places, levels)[0]
        assert abs(found[i] - want) < 0.02, (i, found[i], want)


def test_quality_learns_from_all_labelled_rows(spark):
    """More rows than a bounded sample once took: the moments and the calibration are those of all."""
    n = 210_000
    marked = F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0)
    rows = spark.range(0, n, 1, 4).select("id", F.concat(F.array(marked, F.col("id").cast("double")), F.array_repeat(F.lit(0.0), quality.FEATURES - 2)).alias("x"), marked.alias("y"))
    model = quality.fit(rows, size=8)
    assert abs(model.mean[1] - (n - 1) / 2) < 1e-3 and abs(model.mean[0] - 1 / 3) < 1e-9


# 4. Exact dedup


def duplicates(pairs):
    import re

    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[re.sub(SPACES, " ", t or "")].append(i)
    return groups


def test_exact_duplicates(odd, empty):
    import re

    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    groups, out = duplicates(pairs), exact_dedup.exact_duplicates(odd).collect()
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, keep[n := re.sub(SPACES, " ", t or "")], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in pairs]
    count = lambda rows: collections.Counter(map(tuple, rows))
    assert count((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == count(want)
    assert sum(r["kept"] for r in out) == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    left = exact_dedup.without_copies(odd)
    assert left.columns == odd.columns and left.count() == len(groups)


def test_exact_duplicates_give_sqls_rows(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = "doc_id, keep_id, group_size, kept, text_sha256"
    want = con.execute(f"SELECT {columns} FROM ({SQL['op4_exact_dedup']}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in QUERIES["op4_exact_dedup"](spark, sf).selectExpr(*columns.split(", ")).orderBy("doc_id").collect()] == want


def test_texts_that_share_a_digest_form_groups_of_their_own(spark):
    kind = "id long, digest string, row long, first struct<no_id:boolean,id:long,row:long>, n long"
    first = (False, 1, 10)
    placed = spark.createDataFrame([(1, "d", 10, first, 3), (2, "d", 11, first, 3), (3, "d", 12, first, 3)], kind)
    strays = spark.createDataFrame([("d", 2, 11, "other"), ("d", 3, 12, "other")], "digest string, id long, row long, body string")
    assert sorted((r["id"], r["first"]["id"], r["n"]) for r in exact_dedup._apart(placed, strays).collect()) == [(1, 1, 1), (2, 2, 2), (3, 2, 2)]


# 5. BPE


def test_bpe_agrees_with_the_library(spark, odd, empty):
    tok, path = library("word_bpe_49k.json"), tokenizer_path("word_bpe_49k.json")
    texts = collections.Counter((r["doc_id"], tuple(ids := tok.encode(r["text"] or "", add_special_tokens=False).ids), tok.decode(ids, skip_special_tokens=False)) for r in odd.collect())
    rows = bpe.encode(odd, path)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows.collect()) == texts
    assert collections.Counter((r["doc_id"], r["decoded"]) for r in bpe.decode(rows, path).collect()) == collections.Counter((i, t) for i, _, t in texts.elements())
    digests = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encoded_digests(odd, path).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == collections.Counter((i, len(ids), sha(little(ids)), sha(t.encode())) for i, ids, t in texts.elements())
    assert bpe.encode(empty, path).count() == bpe.encoded_digests(empty, path).count() == 0


def test_the_decoded_text_comes_from_the_ids(monkeypatch):
    """Also where the encoder has met the words before."""
    tok = bpe._tokenizer(tokenizer_path("word_bpe_49k.json"))
    ids, text = tok.encode("one two one")
    one = int.from_bytes(ids[:4], "little")
    monkeypatch.setitem(tok.names, one, "changed")
    assert tok.encode("one two one") == (ids, " ".join("changed" if n == text.split()[0] else n for n in text.split()))


# 6. Licenses


def test_license_words_and_labels(odd, empty):
    out = licenses.scan(odd).collect()
    texts = collections.Counter((r["doc_id"], license_words(r["text"])) for r in odd.collect())
    assert collections.Counter((r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in out) == texts
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in out)
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under the Apache License, Version 2.0 (the License)", "apache,apache-2.0"),
    ("This work is in the public domain.", "public-domain"),
    ("// SPDX-License-Identifier: BSD 3-Clause", "bsd-3-clause"),
    ("released under the GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
    ("a summit and a permit", ""),
    ("we commit licensed work", ""),
])
def test_license_rules(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == labels


@pytest.mark.parametrize(("text", "labels"), [
    ("SPDX-License-Identifier: 0BSD", "0bsd"),
    ("under the zero-clause BSD license", "0bsd"),
    ("released under the Expat license", "mit"),
    ("License: X11", "mit"),
])
def test_license_names_have_keywords_of_their_own(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == labels


def samples(pattern):
    """One text for each way through the alternatives of a rule's pattern; repeats once, optional parts both ways."""
    import itertools
    from re import _constants as c
    from re import _parser

    def each(tokens):
        out = [""]
        for op, arg in tokens:
            if op is c.LITERAL:
                some = [chr(arg)]
            elif op is c.IN:
                some = [{c.CATEGORY_SPACE: " ", c.CATEGORY_WORD: "w"}[arg[0][1]] if arg[0][0] is c.CATEGORY else chr(arg[0][1])]
            elif op is c.BRANCH:
                some = [x for branch in arg[1] for x in each(branch)]
            elif op is c.SUBPATTERN:
                some = each(arg[3])
            else:
                assert op is c.MAX_REPEAT, op
                one = each(arg[2])
                some = list(dict.fromkeys([""] * (arg[0] == 0) + one))
            out = [a + b for a, b in itertools.islice(itertools.product(out, some), 4000)]
        return out

    return each(_parser.parse(pattern))


def test_the_keyword_gate_passes_every_rules_notices(spark):
    rows = [(i, key, t) for i, (_, key, pattern, _, _) in enumerate(licenses.rules()) for t in samples(pattern)[::7] + samples(pattern)[-1:]]
    df = spark.createDataFrame(rows, "rule int, key string, text string").withColumn("low", F.lower("text"))
    out = df.select("rule", "key", "text", licenses.cued(F.col("text"), F.col("low")).alias("cued"), licenses.keywords(F.col("text"), F.col("low")).alias("found")).collect()
    assert {r["rule"] for r in out} == set(range(len(licenses.rules())))
    assert not [r["text"] for r in out if not r["cued"] or not {k.split(" ")[0] for k in r["key"].split("|")} & set(r["found"])]


def test_a_stronger_license_rule_suppresses_what_lies_within_it(spark):
    found = licenses.scan(spark.createDataFrame([(1, "x is licensed under the MIT License.")], "doc_id long, text string")).first()["detections"]
    assert [(d["start"], d["stop"], d["label"], d["rank"]) for d in found] == [(5, 35, "mit", 90)]


def plain_detections(text):
    """Every rule's matches, without a gate; then suppression span by span."""
    text, found = text or "", []
    for label, _, pattern, rank, _ in licenses.rules():
        found += [(m.start(), -m.end(), -rank, label) for m in re.finditer(rf"\b{pattern}(?!\w)", text, re.I | re.S | re.A)]
    outer = []
    for one in sorted(found):
        if not outer or -one[1] > -outer[-1][1]:
            outer.append(one)
    kept = []
    for one in outer:
        if not kept or -kept[-1][1] <= one[0]:
            kept.append(one)
        elif -kept[-1][2] < -one[2]:
            kept[-1] = one
    return [(a, -b, -r, label) for a, b, r, label in kept]


def test_license_detections_against_a_plain_scan(spark, sf):
    rows = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    grants = ["licensed under {}", "{} license", "SPDX-License-Identifier: {}", "see {}; subject to the terms of {}."]
    names = ["MIT", "Apache 2.0", "GPL v2", "GNU General Public License v3.0", "BSD 3-Clause", "CC BY-SA 4.0", "the Artistic License 2.0", "Unlicense"]
    texts = [t for t in rows if t and "licen" in t.lower()][:150] + [g.format(n, n) for g in grants for n in names]
    texts += [s for _, _, p, _, _ in licenses.SENTENCES for s in samples(p)[:1]]
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        assert [(d["start"], d["stop"], d["rank"], d["label"]) for d in r["detections"]] == plain_detections(texts[r["doc_id"]]), texts[r["doc_id"]][:300]
    assert sum(bool(r["detections"]) for r in out) > 150


# 7. Mixing


def test_mixing_stays_within_one_block_of_the_target(spark):
    rows = [(i, "abc"[0 if i < 600 else 1 if i < 900 else 2]) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = sorted(mixing.mixed(df, weights={"a": 6.0, "b": 3.0, "c": 1.0}, block_rows=10).collect(), key=lambda r: r["position"])
    assert sorted(r["doc_id"] for r in out) == list(range(1000)) and len({r["position"] for r in out}) == 1000
    done = collections.Counter()
    for at in range(100):
        block = out[at * 10 : at * 10 + 10]
        assert len({r["source"] for r in block}) == 1
        done[block[0]["source"]] += 1
        assert all(abs(done[s] - w * (at + 1)) < 1 for s, w in (("a", 0.6), ("b", 0.3), ("c", 0.1)))


def dealt(blocks, weights):
    """Asserts that every prefix of the blocks' lanes stays within one block of the ideal, run-outs included."""
    left, done, ideal = collections.Counter(blocks), dict.fromkeys(weights, 0), dict.fromkeys(weights, 0.0)
    for at in blocks:
        done[at] += 1
        time = 1.0
        while time > 1e-9:
            on = [s for s in weights if left[s] - ideal[s] > 1e-9]
            if not on:
                break
            total = sum(weights[s] for s in on)
            step = min([time] + [(left[s] - ideal[s]) * total / weights[s] for s in on])
            for s in on:
                ideal[s] += step * weights[s] / total
            time -= step
        assert all(abs(done[s] - ideal[s]) < 1 + 1e-6 for s in weights), at


def in_blocks(rows, size):
    """The sources of the slots, in turn."""
    slots = collections.defaultdict(set)
    for r in rows:
        slots[r["position"] // size].add(r["source"])
    assert all(len(x) == 1 for x in slots.values()) and sorted(slots) == list(range(len(slots)))
    return [slots[i].copy().pop() for i in sorted(slots)]


def test_mixing_keeps_to_weights_that_no_cycle_of_240_expresses(spark):
    n = {"hot": 60_000} | {f"s{i}": 6_300 for i in range(19)} | {"tiny": 40}
    names = F.array(*(F.lit(s) for s, x in n.items() for _ in range(x // 20)))
    df = spark.range(20 * sum(x // 20 for x in n.values())).select(F.col("id").alias("doc_id"), F.get(names, F.floor(F.col("id") / 20).cast("int")).alias("source"))
    assert df.count() == sum(n.values())
    dealt(in_blocks(mixing.mixed(df).collect(), 32), {s: x**0.5 for s, x in n.items()})
    weights = {s: 1.0 for s in n} | {"hot": 7.1234, "tiny": 0.001}
    dealt(in_blocks(mixing.mixed(df, weights=weights).collect(), 32), weights)


def test_mixing_gives_each_of_many_sources_its_target(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.format_string("s%d", F.floor(F.sqrt("id"))).alias("source"))
    out = mixing.mixed(df, block_rows=4).collect()
    n = collections.Counter(r["source"] for r in out)
    assert len(out) == 20_000 and len(n) == 142 == len({r["lane"] for r in out})
    dealt(in_blocks(out, 4), {s: x**0.5 for s, x in n.items()})


def slot_by_slot(weights, blocks):
    """Earliest deadline first, one slot after the other."""
    reached = lambda v: sum(min(n, w * v) for w, n in zip(weights, blocks))
    window = lambda i, k: (math.floor(reached(k / weights[i]) + 1e-7), math.ceil(reached((k + 1) / weights[i]) - 1e-7))
    at, out = [0] * len(blocks), []
    for now in range(sum(blocks)):
        open_ = [(i, *window(i, at[i])) for i in range(len(blocks)) if at[i] < blocks[i]]
        lane = min(open_, key=lambda x: (0, x[2], x[2], x[0]) if x[1] <= now else (1, x[1], x[2], x[0]))[0]
        out.append((lane, at[lane]))
        at[lane] += 1
    return out


@pytest.mark.parametrize("stretch", [32, 4096])
@pytest.mark.parametrize(("weights", "blocks"), [
    ([0.7, 0.299, 0.001], [700, 299, 3]),
    ([1 / (3 + i) for i in range(60)], [5 + i % 7 for i in range(60)]),
    ([5.0, 1.0, 1.0], [3, 40, 60]),
    ([2.5], [10]),
])
def test_stretches_dealt_at_once_give_the_schedule_slot_by_slot(spark, monkeypatch, weights, blocks, stretch):
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    found = sorted((r["slot"], r["lane"], r["block"]) for r in mixing.schedule(spark, [*weights, 0.0], [*blocks, 4]).collect())
    want = slot_by_slot(weights, blocks) + [(len(weights), k) for k in range(4)]
    assert found == [(slot, *of) for slot, of in enumerate(want)]
    assert mixing.schedule(spark, [], []).count() == 0


def test_mixing_keeps_all_rows(odd, empty):
    rows = odd.drop("lane")
    out = mixing.mixed(rows, block_rows=2).collect()
    assert collections.Counter(tuple(r)[:7] for r in out) == collections.Counter(map(tuple, rows.collect()))
    assert len({r["position"] for r in out}) == len(out) and mixing.mixed(empty).count() == 0
    assert collections.Counter(map(tuple, mixing.in_order(odd).collect())) == collections.Counter(map(tuple, odd.collect()))
    few = mixing.mixed(rows, weights={"s1": 1.0})
    assert few.count() == rows.count() and {r["lane"] for r in few.where("source = 's1'").collect()} == {0}


# 8. SimHash


def test_near_duplicates_and_components(odd, empty):
    for shingle in (3, 5):
        rows, pairs = simhash.near_duplicates(odd, shingle).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()]
        prints = {t: fingerprint(t, shingle) for _, t in pairs}
        root = roots(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
        least = {}
        for i, t in pairs:
            if i is not None:
                least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
        want = collections.Counter((i, prints[t], least.get(root[prints[t]])) for i, t in pairs)
        assert collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows) == want
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.without_near_copies(odd).columns == odd.columns


def test_components_take_few_shuffles(spark, monkeypatch):
    """Stars take no round, and a round deals its rows out five times at most."""
    draw = np.random.default_rng(6)
    stars = [(i, i % 7) for i in range(7, 60)]
    mixed = [(f"n{a:04}", f"n{b:04}") for a, b in [*stars, (58, 59), (100, 3), (100, 200)]]
    plans, written = [], shared.written

    def counted(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, what)

    monkeypatch.setattr(shared, "written", counted)
    for kind, edges in (("bigint", stars), ("bigint", [(3, 3), (None, 4), (5, None)]), ("bigint", [(i, i + 1) for i in range(20)]), ("bigint", draw.integers(0, 90, (70, 2)).tolist()), ("string", mixed)):
        plans.clear()
        linked = {frozenset(e) for e in edges if None not in e and e[0] != e[1]}
        found = shared.components(spark.createDataFrame([tuple(e) for e in edges], f"x {kind}, y {kind}"), "x", "y").collect()
        want = roots(sorted(set().union(*linked)), lambda a, b: frozenset((a, b)) in linked)
        assert sorted(tuple(r) for r in found) == sorted(want.items())
        assert all(x.count("Exchange hashpartitioning") <= 5 for x in plans)
        assert edges is not stars or len(plans) == 1


def test_a_family_of_unlike_texts_makes_few_pairs(spark, monkeypatch):
    """Texts with one to four places of their own: those that are alike are found, the others hardly meet."""
    draw, base = np.random.default_rng(8), [f"w{i}" for i in range(150)]
    texts = [" ".join(w if j not in at else f"x{i}" for j, w in enumerate(base)) for i, at in enumerate(draw.choice(150, (240, 4), replace=True).tolist())]
    texts += [t.replace("w7 ", "w7 w7 ") for t in texts[:20]] + [" ".join(base[:k]) for k in (118, 119, 120, 121, 122, 140)]
    looked, likely = [], simhash._likely

    def counted(pairs, *rest):
        looked.append(pairs.count())
        return likely(pairs, *rest)

    monkeypatch.setattr(simhash, "_likely", counted)
    left = {r["doc_id"] for r in simhash.without_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(simhash.grams(t, 5)) for t in texts]
    root = roots(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    assert left == set(root.values()) and 20 < len(left) < 246
    assert sum(looked) < 10 * len(texts), looked


def test_a_family_makes_few_pairs_whichever_text_comes_first(spark, monkeypatch):
    """The first text differs from the others in so many places that it is like few of them, though it shares their lists."""
    draw, base = np.random.default_rng(5), [f"w{i}" for i in range(150)]
    places = [[75, 100, 125, 145]] + draw.choice(150, (300, 2), replace=True).tolist()
    texts = [" ".join(w if j not in at else f"x{i}" for j, w in enumerate(base)) for i, at in enumerate(places)] + [" ".join(base)]
    looked, likely = [], simhash._likely

    def counted(pairs, *rest):
        looked.append(pairs.count())
        return likely(pairs, *rest)

    monkeypatch.setattr(simhash, "_likely", counted)
    left = {r["doc_id"] for r in simhash.without_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()}
    sets = [set(simhash.grams(t, 5)) for t in texts]
    root = roots(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    assert left == set(root.values())
    assert sum(looked) < 10 * len(texts), looked


def test_lists_meet_in_all_pairs_that_may_be_similar(spark):
    """Against all pairs of each list, with lists of the same nodes and without."""
    draw, posts = np.random.default_rng(6), []
    sizes, root = draw.choice([1, 2, 5, 9, 10, 40, 41, 43, 49, 50, 144, 146, 1800], 90).tolist(), draw.integers(0, 30, 90).tolist()
    lists = [sorted(draw.choice(90, int(draw.integers(2, 25)), replace=False).tolist()) for _ in range(40)]
    start = {g: [int(draw.integers(0, max(1, sizes[n] // 5))) for n in nodes] for g, nodes in enumerate(lists)}
    for g, nodes in enumerate(lists):
        posts += [(g + 100 * twin, n, sizes[n], min(sizes[n] - 1, at + twin), root[n]) for twin in (range(3) if g % 2 else (0,)) for n, at in zip(nodes, start[g])]
    rooted = spark.createDataFrame(posts, "gram long, node long, m int, place int, root long")
    want = set()
    for g in {p[0] for p in posts}:
        for _, a, m, i, r in (p for p in posts if p[0] == g):
            for _, b, n, j, s in (p for p in posts if p[0] == g):
                if a < b and r != s and min(m, n) >= 0.8 * max(m, n) - 1e-6 and min(m - i, n - j) >= 4 / 9 * (m + n) - 1e-6:
                    want.add((a, b))
    for some in (rooted, simhash._without_twins(rooted)):
        assert {tuple(r) for r in simhash._meeting(some, 0.8).collect()} == want and len(want) > 50
    single = rooted.withColumn("root", F.lit(1))
    twins = simhash._without_twins(rooted.where("gram % 2 = 1"))
    assert twins.count() < rooted.where("gram % 2 = 1").count() / 2 and simhash._without_twins(single).count() == 0


def test_what_is_larger_than_it_looks_is_not_broadcast(spark, monkeypatch):
    """Cells of many fingerprints, which explode() makes of a small table, and texts whose files are small."""
    prints = spark.range(40_000).select(F.xxhash64("id").alias("fp"))
    near = simhash.links(prints)
    near.count()
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    monkeypatch.setattr(shared, "FEW_BYTES", 1 << 20, raising=False)
    plans, kept = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, what: plans.append((what, df._jdf.queryExecution().executedPlan().toString())) or kept(df, what))
    words = " ".join(f"w{i % 60}" for i in range(20_000)) + " "
    docs = spark.createDataFrame([(i, words + "x" * i) for i in range(24)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.without_near_copies(docs).collect()] == [0]
    first = dict(reversed(plans))["similar"]
    assert "BroadcastHashJoin" not in first and "SortMergeJoin" in first


def test_many_groups_are_not_broadcast(spark, monkeypatch):
    """Names and sizes of groups, as many as there are different texts, meet the documents by shuffle."""
    plans, kept = [], simhash.written
    monkeypatch.setattr(shared, "FEW_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(simhash, "written", lambda df, what: plans.append((what, df._jdf.queryExecution().executedPlan().toString())) or kept(df, what))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id") % 1000).alias("text"))
    found = simhash.near_duplicates(docs)
    assert found.count() == 2000 and "SortMergeJoin" in dict(plans)["named"]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("SortMergeJoin") == 1


def test_links_lose_no_pair(spark):
    draw = np.random.default_rng(3)
    base = [int(x) for x in draw.integers(0, 1 << 63, 60, dtype=np.uint64)] + [0, (1 << 64) - 1]
    flips = [x ^ sum(1 << int(b) for b in draw.choice(64, int(draw.integers(0, 6)), replace=False)) for x in base for _ in range(8)]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in base + flips})
    df = spark.createDataFrame([(x,) for x in signed] + [(None,)], "fp long")
    for distance in range(4):
        want = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= distance}
        found = [frozenset((r["a"], r["b"])) for r in simhash.links(df, distance).collect()]
        assert set(found) == want and len(found) == len(want)


# 9. Toxicity


def test_toxicity_on_rows_it_has_not_seen(spark, sf):
    wide = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{wide}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op9_toxicity"](spark, wide).collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    bad = [r["toxic"] for r in rows if labels[r["doc_id"]]]
    clean = [r["toxic"] for r in rows if not labels[r["doc_id"]]]
    print(f"toxic caught {sum(bad)} of {len(bad)}, clean flagged {sum(clean)} of {len(clean)}")
    assert sum(bad) >= 0.8 * len(bad) and sum(clean) <= 0.05 * len(clean)
    assert all(0 <= r["severity"] <= 2 and r["toxic"] == (r["p_toxic"] >= 0.5) for r in rows)


def test_toxicity_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, None if i == 4 else i % 2) for i in range(30)] + [(None, 1), (999, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert {r["grade"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_learns_from_few_labels(spark):
    docs = spark.createDataFrame([(0, "vile awful words"), (1, "kind gentle words"), (3, "an awful vile thing"), (4, "a gentle kind thing")], "doc_id long, text string")
    keep = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 0, keep[0]).when(F.col("doc_id") == 1, keep[1]).otherwise(F.col("doc_id") + 1000))
    labels = spark.createDataFrame([(keep[0], 1), (keep[1], 0)], "doc_id long, toxic int")
    assert {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels).collect()} == {keep[0]: 1, keep[1]: 0, 1003: 1, 1004: 0}


def test_ordinal_fit_is_the_most_likely_one():
    """Against the penalised likelihood written out row by row: no step away from the fit raises it."""
    draw = np.random.default_rng(8)
    x = (draw.random((300, 4)) < 0.5).astype(np.float64)
    y = np.clip((x @ [1.5, 1.0, 0, -0.5] + draw.logistic(0, 1, 300)).round(), 0, 2).astype(int)
    ridge = 0.05

    def likelihood(weights, cuts):
        total = -ridge / 2 * sum(w * w for w in weights)
        for row, grade in zip(x, y):
            below = lambda k: 0.0 if k < 0 else 1.0 if k > 1 else 1 / (1 + math.exp(-(cuts[k] - sum(w * v for w, v in zip(weights, row)))))  # noqa: E731, B023
            total += math.log(below(grade) - below(grade - 1))
        return total

    weights, cuts = toxicity.fit_ordinal(x, y, 3, ridge=ridge, rounds=2000)
    best = likelihood(weights, cuts)
    for i in range(6):
        for step in (-0.05, 0.05):
            moved = np.concatenate([weights, cuts])
            moved[i] += step
            assert likelihood(moved[:4], moved[4:]) < best + 1e-3


def test_ordinal_grades_share_weights():
    draw = np.random.default_rng(2)
    x = (draw.random((600, 5)) < 0.5).astype(np.float32)
    y = np.clip(x[:, :2].sum(1), 0, 2).astype(int)
    weights, cuts = toxicity.fit_ordinal(x, y, 3)
    assert min(weights[:2]) > 2 * max(np.abs(weights[2:])) and cuts[0] < cuts[1]


# 10. Language


def test_language_against_plain_expectation_maximisation(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    sums = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang].update(dict(enumerate(language.trigrams(text).tolist())))
    langs = sorted(sums)
    size = {k: sum(v.values()) + 0.5 * language.BUCKETS for k, v in sums.items()}

    def shares(n, some):
        own = [1 / len(some)] * len(some)
        p = {t: [(sums[k][t] + 0.5) / size[k] for k in some] for t in n}
        for _ in range(12):
            new = [0.0] * len(some)
            for t, times in n.items():
                joint = [a * b for a, b in zip(p[t], own)]
                for j, v in enumerate(joint):
                    new[j] += times * v / sum(joint)
            own = [v / sum(n.values()) for v in new]
        return own, sum(times * math.log(sum(a * b for a, b in zip(p[t], own))) for t, times in n.items())

    found = {r["doc_id"]: r for r in language.languages(docs).collect()}
    for i, text, _ in rows[:40]:
        if not text or not any(c.isalpha() for c in text):
            assert found[i]["lang_pred"] == "und"
            continue
        n = {t: c for t, c in enumerate(language.trigrams(text).tolist()) if c}
        all_, _ = shares(n, langs)
        order = sorted(range(len(langs)), key=lambda j: -all_[j])
        chosen = [order[0]]
        own, best = shares(n, [langs[order[0]]])
        for m in range(2, len(order) + 1):
            if all_[order[m - 1]] < 0.005:
                break
            more, level = shares(n, [langs[j] for j in order[:m]])
            if level - 2 * math.log(max(2, sum(n.values()))) <= best:
                break
            own, best, chosen = more, level, order[:m]
            best = level
        top = max(range(len(own)), key=lambda j: own[j])
        assert found[i]["lang_pred"] == langs[chosen[top]] and abs(found[i]["score"] - own[top]) < 1e-6


def test_language_on_rows_it_has_not_seen(spark, sf):
    wide = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{wide}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op10_language"](spark, wide).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in rows) >= 0.97 * len(rows) > 100


def test_mixed_texts_hold_both_languages(spark):
    en, fr = "the cat sat on the mat and the dog ran to the house with this thing ", "le chat est dans la maison et les chiens sont sur une table avec nous "
    docs = spark.createDataFrame([(i, (en, fr)[i % 2] * 3, ("en", "fr")[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    model = language.learn(docs)
    asks = spark.createDataFrame([(1, en * 4), (2, fr * 4), (3, en * 6 + fr * 3), (4, "12 !"), (5, None)], "doc_id long, text string")
    out = {r["doc_id"]: (r["lang_pred"], r["langs"]) for r in language.identify(asks, model).collect()}
    assert out == {1: ("en", ["en"]), 2: ("fr", ["fr"]), 3: ("en", ["en", "fr"]), 4: ("und", []), 5: ("und", [])}


def test_language_on_odd_rows(odd, empty):
    out = language.languages(odd).collect()
    assert len(out) == odd.count() and {r["lang_pred"] for r in out} <= {"en", "und"}
    assert language.languages(empty).count() == 0
