"""The registered queries and the pipeline."""

import random
import re

import pytest
from compare import check, connect
from llm_fixtures import documents, prose
from test_llm_decontam import plain as plain_matches
from test_llm_quality import junk, plain_counts
from test_llm_simhash import plain_components, plain_print

import __spark_entry__ as entry
import corpus_pipeline
from lifetrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert check(spark, con, SF, name, entry.queries()[name], ORACLES.get(name)) is None


def test_every_number_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert "pipeline" in entry.queries()


def small_corpus(rng):
    clean = [prose(rng, rng.randint(40, 160)) for _ in range(60)]
    item = prose(rng, 30)
    texts = clean + [clean[0], clean[0], clean[5], item + " " + prose(rng, 60), None, "", "short"]
    return texts + [t for _ in range(3) for t in junk(rng)], [(1, item), (2, None)]


def test_stages_on_a_small_corpus(spark, tmp_path):
    texts, items = small_corpus(random.Random(32))
    docs = documents(spark, texts, extra=False)
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        made[name] = (before, docs)
        if name != "token_ids":
            assert docs.columns == before.columns

    ids = lambda df: sorted(r.doc_id for r in df.collect())
    before, after = made["quality_rules"]
    kept = ids(after)
    assert all(plain_counts(texts[i])[0] >= 20 for i in kept)
    assert set(range(64)) <= set(kept) and not any(i >= 64 for i in kept)

    before, after = made["simhash_near_dedup"]
    given = ids(before)
    groups = plain_components([plain_print(texts[i]) for i in given])
    assert ids(after) == sorted({given[min(groups[k])] for k in range(len(given))})

    before, after = made["benchmark_decontamination"]
    assert ids(after) == [i for i in ids(before) if not plain_matches(texts[i], items)[4]]
    assert 63 not in ids(after)

    before, after = made["mixing_to_weights"]
    size = {r.source: 0 for r in before.collect()}
    for r in before.collect():
        size[r.source] += len(WORD.findall(r.text))
    taken = dict.fromkeys(size, 0)
    for r in after.collect():
        taken[r.source] += len(WORD.findall(r.text))
        assert set(WORD.findall(r.text)) <= set(WORD.findall(texts[r.doc_id]))
    for k, s in enumerate(sorted(size)):
        assert abs(taken[s] - sum(size.values()) * (k + 1) / 6) <= 0.05 * sum(size.values())

    before, after = made["token_ids"]
    assert ids(before) == ids(after)
    rows = sorted(after.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


def test_pipeline_on_empty_documents(spark, tmp_path):
    documents(spark, [], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
