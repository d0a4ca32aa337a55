"""The pipeline against brute force, stage by stage."""

from collections import defaultdict

import corpus_pipeline as pipeline
import odd
import pytest
from test_shards_dedup import plain_groups
from test_simhash import plain_components, plain_fingerprint
from test_tokens import check_packing

from frameglass.llm import language, quality


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that enter and leave each stage, over the given documents and odd rows beside them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(
        spark.createDataFrame([(100_000 + i, *rest) for i, *rest in odd.rows(2)], odd.DOCS)
    )
    out = {"documents": docs.collect()}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        result = stage(spark, docs, "")
        if name != "packing":
            assert result.columns == docs.columns
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality(stages):
    def kept(r):
        m = dict(zip(quality.MEASURES, quality.measure((r.text or "").encode())))
        n = m["n_words"]
        if n < 20 or 100 * m["n_repeat_words"] > 30 * n:
            return None
        shares = [m["n_symbols"] / n, m["n_capitals"] / max(1, m["n_capitals"] + m["n_small"]), m["n_dup_lines"] / max(1, m["n_lines"])]
        return not any(s > r.hard for s, r in zip(shares, quality.SOFT_RULES)), any(s > r.soft for s, r in zip(shares, quality.SOFT_RULES))

    verdict = {r.doc_id: kept(r) for r in stages["documents"]}
    left = set(ids(stages["quality_rules"]))
    assert left <= {i for i, v in verdict.items() if v and v[0]}
    assert left >= {i for i, v in verdict.items() if v and v[0] and not v[1]}


def test_language(stages, spark):
    before = stages["quality_rules"]
    model = language.fit(spark.createDataFrame(before, odd.DOCS))
    expected = {}
    for r in before:
        found = model.shares(r.text)
        if language.has_letter(r.text) and found[0][1] >= pipeline.LEAST_SHARE:
            expected[r.doc_id] = found[0][0]
    assert {r.doc_id: r.lang for r in stages["language_id"]} == expected


def test_exact(stages):
    kept = {g[0] for g in plain_groups([tuple(r) for r in stages["language_id"]]) if g[3]}
    assert ids(stages["exact_dedup"]) == sorted(kept)


def test_near(stages):
    rows = sorted(stages["exact_dedup"], key=lambda r: r.doc_id)
    first = plain_components([plain_fingerprint(r.text) for r in rows])
    assert ids(stages["simhash"]) == sorted({rows[i].doc_id for i in first})
    assert len(stages["simhash"]) < len(rows)


def test_packing(stages):
    rows = [tuple(r) for r in stages["simhash"]]
    padding, total = check_packing(rows, stages["packing"])
    assert padding <= 0.01 * total


def test_each_stage_decides(stages):
    sizes = [len(stages[n]) for n in ("documents", "quality_rules", "exact_dedup", "simhash")]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4


def test_run_and_nothing(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    pieces = defaultdict(int)
    for r in pipeline.run(spark, "/root/testdata/sf0.001").collect():
        pieces[r.doc_id] += r.length
    assert len(pieces) > 100
