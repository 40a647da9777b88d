"""Learned operators: matching against brute force, held-out accuracy, odd tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewatch.llm import decontaminate, mixing, queries, toxicity
from framewatch.llm.common import bucket_of, texts
from framewatch.llm.words import words

from .test_llm import SPLIT, docs, prose, removed

SMALL = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


# --- 5 ----------------------------------------------------------------------------


def test_folding_of_look_alikes():
    for text in ("Ьad", "Ъad", "ьad", "вad", "báḋ", "b̶a̶d̶", "ｂａｄ", "b​ad", "BАD", "b4d"):
        assert toxicity.fold(text) == " bad ", text
    assert toxicity.fold("ćlown") == toxicity.fold("clown") == " ciown "


def test_matches_and_exceptions_are_those_of_brute_force():
    rng = random.Random(41)
    lexicon = toxicity.Lexicon({f" {prose(rng, 1, 'abc')}": rng.random() + 0.1 for _ in range(30)}, frozenset(prose(rng, 2, "abc") for _ in range(60)), (-1.0, 1.0, 1.0, 1.0))
    automaton = lexicon.automaton()
    for _ in range(200):
        text = prose(rng, rng.randint(0, 30), "abc")
        w = text.split()
        total = []
        for i, word in enumerate(w):
            entries = [e for e in lexicon.entries if f" {word}".startswith(e)]
            around = {word, *([f"{w[i - 1]} {word}"] if i else []), *([f"{word} {w[i + 1]}"] if i + 1 < len(w) else [])}
            if entries and not around & lexicon.exceptions:
                total.append(lexicon.entries[max(entries, key=len)])
        a, b, c = toxicity.measure(text, automaton, lexicon.exceptions)
        assert c == max(total, default=0) and b == pytest.approx(math.log1p(sum(total)))
        assert a == pytest.approx(math.log1p(100 * sum(total) / (len(w) + 10)))


def test_an_exception_holds_at_every_place():
    lexicon = toxicity.Lexicon({" bad": 3.0}, frozenset({f"bad {'z' * 300}", f"{'y' * 300} bad"}))
    automaton = lexicon.automaton()
    for lead in (0, 1, 70, 5_000, 50_000):
        for phrase in (f"bad   {'z' * 300}", f"{'y' * 300}   bad"):
            assert toxicity.measure("w " * lead + phrase + " end", automaton, lexicon.exceptions)[2] == 0.0
            assert toxicity.measure("w " * lead + phrase.replace("  ", " x "), automaton, lexicon.exceptions)[2] == 3.0


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    got = queries.op5(spark, LARGE).filter("held_out").join(labels, "doc_id").agg(F.sum("toxic").alias("bad"), F.sum(F.col("toxic") * F.col("predicted")).alias("caught"), F.sum("predicted").alias("said")).first()
    assert got.caught >= 0.9 * got.bad and got.caught >= 0.95 * got.said


def test_toxicity_of_odd_tables(spark):
    empty = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    rows = docs(spark, [(1, "a b"), (1, "a b"), (None, None), (2, "x" * 300_000)]).withColumn("a", F.lit("clash")).withColumn("toxic", F.lit(9))
    got = toxicity.score(rows, empty).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and all(r.a == "clash" for r in got)
    assert toxicity.score(rows.limit(0), empty).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (7, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    assert toxicity.labelled_sample(rows, labels).count() == 2
    assert spark.range(1).select(bucket_of(F.lit(None).cast("long"), 3).alias("b")).first().b == 0


# --- 10 ---------------------------------------------------------------------------


def mixed(spark, n=150):
    rng = random.Random(12)
    df = docs(spark, [(i, prose(rng, rng.randint(0, 90), "abcd" if i % 4 else "wxyz")) for i in range(n)] + [(500, None), (501, ""), (3, "twice"), (3, "twice")])
    labelled = df.filter("doc_id < 60").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, "rare").otherwise("common").alias("domain"))
    return df, mixing.fit(labelled)


def test_rates_are_those_of_plain_projected_gradient(spark):
    df, model = mixed(spark)
    out = mixing.mix_to_targets(df, model, {"rare": 0.6, "common": 0.4}).collect()
    p, n = np.array([r.posterior for r in out]), np.array([r.n_tokens for r in out])
    targets, mass = n.sum() * np.array([0.4, 0.6]), n @ p
    assert model.domains == ["common", "rare"]
    rate = np.ones(len(out))
    for _ in range(mixing.STEPS):
        now = (rate * n) @ p
        if (np.abs(now - targets) <= mixing.TOLERANCE * targets).all():
            break
        rate = np.maximum(0, rate - p @ ((now - targets) / mass))
    assert np.allclose([r.rate for r in out], rate) and len(out) == 154
    gap = (np.abs((rate * n) @ p - targets) / targets).max()
    assert all(r.gap == pytest.approx(gap) and r.domain == model.domains[int(np.argmax(r.posterior))] for r in out) and gap <= mixing.TOLERANCE


def test_the_training_gradient_of_domains():
    """The classifier is the softmax that brute force gives."""
    rng = np.random.default_rng(2)
    column = texts(pa.array(["a b c", "a a", "", "d e f g"] * 5))
    bucket, value, offsets = mixing.sparse(column)
    target = rng.integers(0, 3, 20)
    weights, bias = mixing.train(bucket, value, offsets, target, 3)
    x = np.zeros((20, mixing.BUCKETS))
    for i in range(20):
        x[i, bucket[offsets[i] : offsets[i + 1]]] = value[offsets[i] : offsets[i + 1]]
    assert np.allclose(x.sum(axis=1), [2, 2, 0, 2] * 5)
    want = mixing.softmax(x @ weights + bias)
    assert np.allclose(mixing.softmax(mixing.logits(words(column), weights, bias)), want, atol=1e-6)
    hot = np.eye(3)[target]
    assert np.abs((want - hot).mean(axis=0)).max() < 0.05  # the bias is at its optimum


def test_targets_out_of_reach_are_told(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 5)
    df, model = mixed(spark, 40)
    with pytest.warns(UserWarning, match="stay off"):
        out = mixing.mix_to_targets(df.filter("doc_id % 4 != 0"), model, {"rare": 1.0, "common": 0.0}).collect()
    assert out[0].gap > mixing.TOLERANCE and all(r.rate >= 0 for r in out)


def test_mixing_of_odd_tables(spark):
    df, model = mixed(spark, 30)
    clash = df.withColumns({c: F.lit(c) for c in ("n_tokens", "posterior", "rate", "domain", "gap", "in_rate", "_q")})
    out = mixing.mix_to_targets(clash, model, {})
    assert out.columns == [*df.columns, "in_n_tokens", "in_posterior", "in_in_rate", "in_domain", "in_gap", "in_rate", "_q", "n_tokens", "posterior", "rate", "domain", "gap"]
    assert all(r.in_in_rate == "rate" and r.in_rate == "in_rate" for r in out.collect())
    assert mixing.mix_to_targets(df.limit(0), model, {"rare": 1.0}).count() == 0
    none = mixing.mix_to_targets(df, mixing.fit(df.limit(0).withColumn("domain", F.lit("x"))), {}).collect()
    assert {(r.rate, r.domain, r.gap) for r in none} == {(1.0, None, 0.0)}
    long = docs(spark, [(1, "word " * 200_000)])
    assert mixing.mix_to_targets(long, model, {}).first().n_tokens == 200_000


# --- the pipeline -----------------------------------------------------------------


def test_pipeline_on_empty_and_odd_documents(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "not there at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"rate", "domain", "posterior", "n_tokens"} <= set(out.columns)
    odd = docs(spark, [(None, None), (1, None), (1, None), (2, ""), (3, "a b c " * 30)]).withColumn("rate", F.lit("clash"))
    got = corpus_pipeline.mix_domains(spark, odd, str(tmp_path))
    assert got.count() == 5 and {r.in_rate for r in got.collect()} == {"clash"}


def test_every_stage_of_the_pipeline_is_its_brute_force(spark):
    now = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 4000 or text is null")
    now = spark.createDataFrame(now.collect(), now.schema)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        now = stage(spark, now, SMALL)
        rows = now.collect()
        after = {r.doc_id: r for r in rows}
        assert len(rows) == len(after)
        if name == "toxicity":  # the lexicon as learned, each text measured alone
            learned = [r for r in before.values() if r.doc_id in labels and labels[r.doc_id].toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
            lexicon = toxicity.fit(spark.createDataFrame([(r.text, int(labels[r.doc_id].toxic)) for r in learned], "text string, toxic int"))
            automaton = lexicon.automaton()
            z = {i: lexicon.curve[0] + sum(a * b for a, b in zip(lexicon.curve[1:], toxicity.measure(r.text or "", automaton, lexicon.exceptions))) for i, r in before.items()}
            assert set(after) == {i for i, v in z.items() if 1 / (1 + math.exp(-max(-30, min(30, v)))) < toxicity.THRESHOLD} and len(after) < len(before)
        if name == "ngram_jaccard_join":
            sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := SPLIT.findall(r.text or "")) else frozenset() for i, r in before.items()}
            least = {i: i for i in sets}
            pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(n := sets[a] & sets[b]) and len(n) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
            for _ in sets:
                new = dict(least)
                for a, b in pairs:
                    new[a] = new[b] = min(new[a], new[b])
                if new == least:
                    break
                least = new
            assert set(after) == {i for i in sets if least[i] == i} and len(after) < len(before)
        if name == "substring_dedup":
            want = removed([(i, r.text) for i, r in before.items()], 13)
            assert {i: hashlib.sha256(" ".join(SPLIT.findall(r.text or "")).encode()).hexdigest() for i, r in after.items()} == {i: v[2] for i, v in want.items()}
            assert all(r.n_chars == (before[i].n_chars if want[i][1] == 0 else len(r.text)) for i, r in after.items())
        if name == "benchmark_decontamination":
            hashed = lambda t: words(texts(pa.array([t], pa.string())), lower=True).hashes
            bad = set()
            for (i, r), (_, item) in itertools.product(before.items(), items):
                a, b = hashed(r.text), hashed(item)
                if len(a) and len(b) and np.isin(b, a).mean() >= 0.8 and decontaminate.best_match(b, a)[0] <= len(b) * decontaminate.EDITS + 1e-9:
                    bad.add(i)
            assert set(after) == set(before) - bad
        if name == "mixing":
            assert set(after) == set(before)
            total = np.sum([r.rate * r.n_tokens * np.array(r.posterior) for r in rows], axis=0)
            model = mixing.fit(mixing.labelled_domains(spark.createDataFrame(list(before.values())), spark.read.parquet(f"{SMALL}/labels.parquet")))
            want = mixing.even_languages(model.domains)
            mass = sum(len(SPLIT.findall(r.text or "")) for r in before.values())
            assert rows[0].gap <= mixing.TOLERANCE and np.allclose(total / mass, [want[d] for d in model.domains], rtol=2e-3)
        else:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = spark.createDataFrame(rows, now.schema)
