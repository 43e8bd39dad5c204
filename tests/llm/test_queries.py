"""The registered queries by name: their columns, and the rows of those that SQL cannot express."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brindle.llm import language_id, toxicity
from tests.llm.test_corpus_operators import every_segment, plain_bundle

COLUMNS = {
    "op1_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"], "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op6_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op8_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op9_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    docs = corpus.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "xx").when(F.col("doc_id") % 3 == 1, "yy").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    bad = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" nasty vilestem nasty"))).otherwise(F.col("text"))
    docs.withColumn("text", bad).write.parquet(f"{root}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic")).distinct().write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([("q1", "w1 w2"), ("q2", "one two three four five six seven eight nine ten eleven")], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="module")
def texts(spark, folder):
    return [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    assert set(COLUMNS[name]) <= set(df.columns)
    kinds = dict(df.dtypes)
    for c in COLUMNS[name]:
        want = "boolean" if c in ("held_out", "kept", "over_limit", "contaminated") else "string" if c.endswith("sha256") or c == "lang_pred" else "double" if c == "score" else "int" if c == "predicted" else "bigint"
        assert kinds[c] == want, c


def sorted_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_op1_by_the_library(spark, folder, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc, text, _ in texts:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        while at < len(ids):
            n = min(2048, 1 << ((len(ids) - at).bit_length() - 1))
            want.append((doc, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), 0))
            at += n
    df = entry.queries()["op1_packing"](spark, folder)
    assert sorted_rows(df, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset") == sorted(want, key=repr)
    assert df.select("sequence_id").distinct().count() == len(want)


def test_op7_by_the_library(spark, folder, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(d, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for d, x, _ in texts]
    assert sorted_rows(entry.queries()["op7_token_counts"](spark, folder), *COLUMNS["op7_token_counts"]) == sorted(want, key=repr)


def test_op4_by_brute_force(spark, folder, texts):
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    made = [plain_bundle(t, language_id.DIMENSION).astype(float) for _, t, _ in texts]
    sums = {}
    for (d, _, lang), v in zip(texts, made, strict=True):
        if lang is not None and not held(d):
            sums[lang] = sums.get(lang, 0) + v
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in entry.queries()["op4_language_id"](spark, folder).collect()), key=repr)
    want = []
    for (d, t, _), v in zip(texts, made, strict=True):
        near = {k: float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)) for k, s in sums.items()} if v.any() else {}
        best = min(near, key=lambda k: (-near[k], k)) if near else "und"
        want.append((d, held(d), best, min(1.0, max(0.0, near.get(best, 0.0))), near))
    want.sort(key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(sorted(got, key=lambda r: (r[0], r[3])), sorted(want, key=lambda r: (r[0], r[3])), strict=True):
        assert abs(g[3] - w[3]) < 1e-4 and (g[2] == w[2] or abs(w[4][g[2]] - w[4][w[2]]) < 1e-5)


def test_op2_by_brute_force(spark, folder, texts):
    """Scores are those of the model, worked out from every segment by definition; held-out rows teach nothing."""
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    labels = read("labels").select("doc_id", "toxic")
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    model = toxicity.learn(read("documents"), labels.filter(language_id.remainder(3) != 1))
    other = toxicity.learn(read("documents"), labels.withColumn("toxic", F.when(language_id.remainder(3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))).filter(language_id.remainder(3) != 1))
    assert model == other and model.weights
    got = sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in entry.queries()["op2_toxicity"](spark, folder).collect()), key=repr)
    want = []
    for d, text, _ in texts:
        own, scores = toxicity.words(text), toxicity.Scores(model.weights)
        each = [(-model.drift if scores[w] is None else scores[w] - model.drift) for w in own]
        if any(scores[w] is not None for w in own) and len(own) < 200:
            excess = [model.rate * s - math.log(model.scale * len(own)) for _, _, s in every_segment(each)]
            real = [e for e in excess if e >= -math.log(model.level)]
            x = (max([0.0, *excess]), math.log1p(len(real)), math.log1p(sum(real)))
        elif len(own) < 200:
            x = (0.0, 0.0, 0.0)
        else:
            x = toxicity.features(own, model, scores)[2]
        p = 1 / (1 + math.exp(-(model.curve[0] + sum(a * b for a, b in zip(model.curve[1:], x, strict=True)))))
        want.append((d, held(d), p, int(p >= 0.7)))
    want.sort(key=repr)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want, strict=True)) < 1e-9
    assert sum(w[3] for w in want if w[0] % 5 == 0) >= 0.9 * sum(w[0] % 5 == 0 for w in want) and sum(w[3] for w in want if w[0] % 5) == 0
