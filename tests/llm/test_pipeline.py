"""The corpus pipeline: each stage against brute force on its own input, and the whole run."""

import re
import zlib

import corpus_pipeline as pipeline
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.llm import pii, toxicity
from tests.llm.test_queries import components, removed, shingles, similar

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out, as rows by doc_id."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "pii", "packing"]
    assert all(stages[n][0].schema == stages[n][1].schema for n, _ in pipeline.STAGES[:-1])


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    lexicon = toxicity.learn(spark, before, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert set(texts(after)) == {i for i, t in texts(before).items() if lexicon.score(lexicon.evidence(t)) < 0.7}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    clean = [i for i in texts(before) if labels.get(i) == 0]
    assert sum(i in texts(after) for i in clean) >= 0.98 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = map(texts, stages["ngram_jaccard_join"])
    sets = {i: shingles(t, 5) for i, t in before.items()}
    want = components(similar(sets, 80), sets)
    assert set(after) == set(want.values()) < set(want) and all(after[i] == before[i] for i in after)


def test_repeated_passages_go(stages):
    before, after = map(texts, stages["substring_dedup"])
    ids = sorted(before)
    for i, (_, gone, kept) in zip(ids, removed([before[i] for i in ids], 20), strict=True):
        assert after[i] == (" ".join(kept) if gone else before[i])
    lengths = {r["doc_id"]: (r["n_chars"], r["text"]) for r in stages["substring_dedup"][1].collect()}
    assert all(n == len(t) for i, (n, t) in lengths.items() if t is not None and after[i] != before[i])


def test_personal_data_is_marked(spark, stages):
    before, after = stages["pii"]
    spans = {r["doc_id"]: sorted((s["start"], -s["end"], s["kind"]) for s in r["spans"]) for r in pii.spans(before.select("doc_id", "text"), pii.fit(before)).collect()}
    got, marked = texts(after), 0
    for i, text in texts(before).items():
        out, at = [], 0
        for start, end, kind in spans[i]:
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
                at = -end
        assert got[i] == ("".join(out) + text[at:] if spans[i] else text)
        marked += bool(spans[i])
    assert marked and not any(re.search(r"@mail[0-9]\.example\.com", t or "") for t in got.values())


def test_everything_is_packed(stages):
    before, after = stages["packing"]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(texts(before))
    per = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["length"]
    assert all(per[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_run_is_all_stages(spark, stages):
    got = pipeline.run(spark, DATA).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"))
    want = stages["packing"][1].groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"))
    assert sorted((r["doc_id"], r["n"]) for r in got.collect()) == sorted((r["doc_id"], r["n"]) for r in want.collect())
