"""The classifier on held-out rows, token counts against the library, and the pipeline stage by stage."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import pytest
from helpers import frame, prose
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterflow.llm import decontaminate, neardup, quality, tokens
from meterflow.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_small):
    scored = QUERIES["op3_quality"](spark, sf_small)
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert scored.count() == spark.read.parquet(f"{sf_small}/documents.parquet").count()


def test_labels_of_held_out_rows_are_not_used(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    labels = spark.read.parquet(f"{sf_tiny}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score_quality(docs, turned).collect()}
    assert a == pytest.approx(b, abs=1e-9)


def test_quality_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "words here"), (4, "x" * 200_000), (4, "again")])
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 7), (9, 0)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.score_quality(docs, labels.limit(0)).collect()} == {(0.5, 1)}
    assert quality.score_quality(docs, labels).count() == 5
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    kept = quality.filter_quality(docs.withColumnRenamed("lang", "_score"), labels.limit(0), threshold=0.5)
    assert kept.count() == 5


def test_isotonic_is_the_closest_rising_sequence():
    assert quality.isotonic(np.array([0.0, 2.0, 1.0, 3.0]), np.ones(4)).tolist() == [0.0, 1.5, 1.5, 3.0]
    assert quality.isotonic(np.array([3.0, 1.0]), np.array([1.0, 3.0])).tolist() == [1.5, 1.5]


def test_sums_of_sums(spark):
    parts = spark.createDataFrame([(i, np.array([i, 1.0]).tobytes()) for i in range(40)], "part long, sums binary")
    assert quality._summed(parts, 40).tolist() == [780.0, 40.0]


TEXTS = [
    "Hello   World's 42nd\n\n\ttest", None, "", " \n", "É é e\u0301 ﬁ Σας ΣΑΣ", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "x" * 20_000, "日本語 テキスト", "a\x1cb\u00a0c\u2028d\x0be",
    "don't we'll I'M", prose(3000, 4), "a", "a",
]


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(path(tokens.TOKENIZER))
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    docs = frame(spark, TEXTS).withColumnRenamed("lang", "n_tokens")
    rows = tokens.count_tokens(docs, prefixes=True).withColumn("cut", tokens.truncated(7)).withColumn("inner", tokens.tokens_between(1, 3)).collect()
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        raw = text.encode()
        assert (r.n_bytes, r.n_tokens) == (len(raw), count(text))
        ends = r.prefix_ends[:40]
        assert [count(raw[:e].decode()) for e in ends] == r.prefix_tokens[: len(ends)]
        words = raw.split()
        assert r.inner == sum(count(w.decode()) for w in words[1:3])
        if TEXTS[r.doc_id] is None:
            assert r.cut is None
        else:
            fitting = [e for e, n in zip(r.prefix_ends, r.prefix_tokens) if n <= 7]
            assert r.cut == (raw[: fitting[-1]].decode() if fitting else "")
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_the_query_digests_the_prefix_counts(spark, sf_tiny):
    library = Tokenizer.from_file(path(tokens.TOKENIZER))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()}
    for r in QUERIES["op10_token_counts"](spark, sf_tiny).where("doc_id % 9 = 0").collect():
        words = texts[r.doc_id].encode().split()
        sums = np.cumsum([len(library.encode(w.decode(), add_special_tokens=False).ids) for w in words]).tolist()
        assert r.n_prefixes == len(words) and r.prefixes_sha256 == hashlib.sha256(",".join(map(str, sums)).encode()).hexdigest()
        assert r.n_tokens == (sums[-1] if sums else 0) == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        within = texts[r.doc_id].encode()[: r.bytes_within_limit].decode()
        assert len(within.split()) == sum(n <= 2048 for n in sums)


def test_forgotten_words_are_asked_again(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    counts = tokens.WordCounts(tokens.TOKENIZER)
    text = prose(200, 1).encode()
    whole = len(counts.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
    assert tokens.prefix_counts(text, counts)[-1] == whole and len(counts) <= 3


def test_stages_of_the_pipeline(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "mixing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_tiny}/labels.parquet").collect()}
    kept = corpus_pipeline.keep_quality(spark, docs, sf_tiny).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert sum((i in ids) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    lined = corpus_pipeline.drop_repeated_lines(spark, kept, sf_tiny).cache()
    assert lined.columns == docs.columns and lined.where("n_chars != length(text)").count() == 0
    near = corpus_pipeline.drop_near_copies(spark, lined, sf_tiny).cache()
    assert {r.doc_id for r in near.collect()} == {r.id for r in neardup.near_duplicates(lined).where("kept").collect()}
    clean = corpus_pipeline.drop_contaminated(spark, near, sf_tiny).cache()
    bench = spark.read.parquet(f"{sf_tiny}/benchmark.parquet")
    assert decontaminate.find_hits(clean, bench).agg(F.max("n_hit")).first()[0] == 0 and clean.columns == docs.columns
    mixed = corpus_pipeline.mix(spark, clean, sf_tiny)
    assert mixed.where("taken > 0 and taken <= 2 * size").count() == mixed.count() > 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, sf_tiny, stage):
    docs = frame(spark, [(1, None), (2, ""), (None, "some words"), (4, prose(30, 1)), (4, prose(30, 1))])
    out = corpus_pipeline.STAGES[stage][1](spark, docs, sf_tiny)
    assert set(docs.columns) <= set(out.columns)
    out.count()
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), sf_tiny).count() == 0


def test_copies_have_one_survivor_after_line_and_near_dedup(spark, sf_tiny):
    body = [prose(9, 600 + k) for k in range(12)]
    near = [*body[:5], body[5] + " edited", *body[6:]]
    docs = frame(spark, [(1, "\n".join(body)), (2, "\n".join(body)), (3, "\n".join(near)), (4, prose(60, 700))])
    lined = corpus_pipeline.drop_repeated_lines(spark, docs, sf_tiny)
    left = corpus_pipeline.drop_near_copies(spark, lined, sf_tiny)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "\n".join(body)), (4, prose(60, 700))]
