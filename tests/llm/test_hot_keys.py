"""Bounded samples, rows that repeat ids, hot keys, and FTRL against dictionaries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselode.llm import exact_dedup, quality, simhash, toxicity, warc
from caselode.llm.common import spread_join


def test_sample_has_one_row_an_id_and_bounded_bytes(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(50)] + [(i, "x" * 10) for i in range(2, 30)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, quality int")
    every = lambda i: F.lit(True)
    assert quality.labelled_texts(docs, labels, "quality", every, 2).count() == 2
    got = quality.labelled_texts(docs, labels, "quality", every, 100).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 30))
    few = quality.labelled_texts(docs, labels, "quality", every, 100, max_bytes=100).collect()
    assert 0 < sum(len(r.text) for r in few) <= 100 and {r.doc_id for r in few} < {r.doc_id for r in got}


def test_near_copies_with_repeated_ids_lose_no_text(spark):
    rows = [(3, "q w e r t y", 1), (5, "q w e r t y", 2), (5, "completely different words that stand here alone", 3), (None, "other text altogether, with no copy", 4), (None, "q w e r t y", 5), (3, "q w e r t y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.fp for r in simhash.drop_near_copies(docs).collect()))
    assert len(got) == 3 and {3, 4} < set(got) and set(got) & {1, 6}
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0 and simhash.drop_near_copies(docs).columns == docs.columns
    nothing = spark.createDataFrame([(None, None), (None, ""), (7, None)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.drop_near_copies(nothing).collect()] == [7]


STRANGE = [(1, None, 0.1, 1), (2, "", 0.2, 0), (2, "", 0.2, 0), (None, "XX!! XX!!", None, 3), (3, "w " * 50_000, 0.4, 4), (1, None, 0.1, 1)]


@pytest.mark.parametrize("stage", [quality.keep_good, toxicity.drop_toxic])
def test_filter_stages_keep_rows_as_they_are(spark, stage):
    docs = spark.createDataFrame(STRANGE, "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").limit(0)
    got = stage(docs, labels)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(STRANGE, key=repr)
    assert stage(docs, labels, threshold=0.5).count() == (len(STRANGE) if stage is quality.keep_good else 0)
    assert stage(docs.limit(0), labels).count() == 0


def test_filter_stages_agree_with_scores(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == good
    clean = {r.doc_id for r in toxicity.classify(docs, labels).collect() if not r.predicted}
    assert {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()} == clean


def test_document_quality_is_the_mean_of_line_marginals_by_bytes(spark):
    rng = np.random.default_rng(2)
    model = {"theta": rng.normal(size=quality.WIDTH + 5), "mean": rng.normal(size=quality.WIDTH), "scale": np.ones(quality.WIDTH)}
    texts = ["Ab 1!\n\nthe the the", "", "one line", None, "x\ny\nx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        per_text, size, x = quality.line_features([t or ""])
        p, _, _ = quality.marginals(per_text, (x - model["mean"]) @ model["theta"][: quality.WIDTH] + model["theta"][quality.WIDTH], model["theta"][-4:].reshape(2, 2))
        weight = np.array([len(line.encode()) + 1 for line in lines])
        assert got[i].n_lines == len(lines) and got[i].score == pytest.approx((p * weight).sum() / weight.sum(), abs=1e-4)


def test_ftrl_against_dictionaries():
    rng = np.random.default_rng(4)
    docs = [(np.unique(rng.integers(0, 40, rng.integers(0, 12))), int(rng.integers(0, 2))) for _ in range(300)]
    z, n = np.zeros(41), np.zeros(41)
    for _ in range(2):
        toxicity._train(z, n, docs, 0.5, 1.0, 0.7, 0.1, 3.0)
    zs, ns = {}, {}

    def weight(i):
        l1 = 0 if i == 40 else 0.7
        v = zs.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((1.0 + math.sqrt(ns.get(i, 0.0))) / 0.5 + 0.1)

    for _ in range(2):
        for index, y in docs:
            keys = [*index.tolist(), 40]
            w = {i: weight(i) for i in keys}
            p = 1 / (1 + math.exp(-sum(w.values())))
            g = (p - y) * (3.0 if y else 1.0)
            for i in keys:
                rate = (math.sqrt(ns.get(i, 0.0) + g * g) - math.sqrt(ns.get(i, 0.0))) / 0.5
                zs[i] = zs.get(i, 0.0) + g - rate * w[i]
                ns[i] = ns.get(i, 0.0) + g * g
    assert np.allclose(z, [zs.get(i, 0.0) for i in range(41)]) and np.allclose(n, [ns.get(i, 0.0) for i in range(41)])


def test_scores_are_those_of_the_learned_weights(spark):
    import xxhash

    rows = [(i, w, y) for i in range(120) for w, y in [(f"bad{i % 3} word here you", 1), (f"nice{i % 4} word there we", 0)]]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    at, w, bias = toxicity.fit(labelled)
    weights = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert 0 < len(weights) < 60
    mix = [int(m) for m in toxicity._MIX]
    text = "Bad0, word HERE nice1"
    h = [xxhash.xxh64_intdigest(x.strip(",").lower(), 7) for x in text.split()]
    found = {x * mix[0] % 2**64 for x in h} | {(a ^ b * mix[1] % 2**64) * mix[0] % 2**64 for a, b in zip(h, h[1:], strict=False)}
    found |= {(a ^ b * mix[2] % 2**64) * mix[0] % 2**64 for a, b in zip(h, h[2:], strict=False)}
    logit = bias + sum(weights.get(i, 0.0) for i in {x >> 44 for x in found})
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), (at, w, bias)).first().score
    assert got == pytest.approx(1 / (1 + math.exp(-logit)))


def test_hot_keys_are_dealt_out(spark):
    left = spark.range(30_000).select(F.col("id"), F.when(F.col("id") < 12_000, 1).otherwise(F.col("id") % 5_000).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    got = spread_join(left, right, ["k"], "n", ["id"], parts=10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert spread_join(left.limit(0), right.limit(0), ["k"], "n", ["id"]).count() == 0


def test_exact_dedup_of_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(docs)
    assert got.where("kept").count() == 1001 and got.where("group_size = 2000 and keep_id = 2999").count() == 2000 and got.count() == 3000


def test_record_ids_are_unique_and_reads_are_spread(spark, tmp_path):
    rows = [(i % 7 if i % 5 else None, f"u{i}", f"<p>{i % 9}</p>" * 50) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(pages, folder)
    got = warc.read_records(index, folder, gap=10, most=200, task_bytes=2000)
    assert got.count() == 200 and got.rdd.getNumPartitions() > 4
    import glob
    import gzip
    import re

    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/w/*.warc.gz"))
    ids = re.findall(rb"WARC-Record-ID: (\S+)\r\nWARC-Date: \S+\r\n(X-Page-ID: \d+)?", whole)
    assert len(ids) == 200
    named = set(re.findall(rb"WARC-Refers-To: (\S+)", whole))
    assert named <= {i for i, _ in ids}




def test_one_huge_text_does_not_end_the_sample(spark):
    """Nor do ids without a document take the places of others."""
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 3 == 0 else 20)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality.labelled_texts(docs, labels, "quality", lambda i: F.lit(True), 1000, max_bytes=1000).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(30) if i % 3]
    assert quality.labelled_texts(docs, labels, "quality", lambda i: F.lit(True), 30).count() == 30
