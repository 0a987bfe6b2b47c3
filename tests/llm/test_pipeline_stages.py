"""The pipeline, stage by stage, each against brute force on what it was given; awkward and empty tables."""

import collections
import json

import pytest

from tests.llm.test_operators import AWKWARD, SCHEMA, brute_components
from tidewick.llm import line_dedup, pipeline, quality_classifier

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return [docs, *pipeline.run_stages(spark, docs, SF, str(tmp_path_factory.mktemp("stages")))]


def rows(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_quality_stage_keeps_what_is_scored_good(spark, tables):
    before, after = rows(tables[0]), rows(tables[1])
    scores = {r.doc_id: r.predicted for r in quality_classifier.score_quality(tables[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert after == {d: r for d, r in before.items() if scores[d] == 1} and 0 < len(after) < len(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d in labels if labels[d] == 1]
    assert sum(d in after for d in good) >= 0.9 * len(good)


def test_line_stage_equals_brute_force(tables):
    before, after = rows(tables[1]), rows(tables[2])
    sites, keeper = collections.defaultdict(set), {}
    for d, r in before.items():
        for x in (r["text"] or "").split("\n"):
            if k := x.strip(" "):
                sites[k].add(r["source"] or "")
                keeper[k] = min(keeper.get(k, d), d)
    hot = {k for k, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    want = {}
    for d, r in before.items():
        every = (r["text"] or "").split("\n")
        left = [x for x in every if x.strip(" ") not in hot or keeper[x.strip(" ")] == d]
        if len(left) == len(every) or any(x.strip(" ") for x in left):
            text = "\n".join(left)
            want[d] = {**r, "text": text, "n_chars": len(text)}
    assert after == want


def test_near_duplicate_stage_equals_brute_force(tables):
    before, after = rows(tables[2]), rows(tables[3])
    top = brute_components([(d, r["text"]) for d, r in before.items()], 80)
    assert after == {d: r for d, r in before.items() if top[d][1] == d} and len(after) < len(before)


def test_decontamination_stage_takes_what_holds_an_item(spark, tables):
    before, after = rows(tables[3]), rows(tables[4])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {d for d, r in before.items() if any(" ".join(i.split()) in " ".join((r["text"] or "").split()) for i in items)}
    assert holds and not holds & set(after) and all(before[d] == r for d, r in after.items()) and len(after) > 0.8 * (len(before) - len(holds))


def test_mixing_stage_draws_from_what_was_left(tables):
    before, after = rows(tables[4]), tables[5].collect()
    assert after and {r.doc_id for r in after} <= set(before) and all(r.copies >= 1 and r.weight > 0 for r in after)


def written(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return folder


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and columns of clashing names beside documents that are labelled."""
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(r[0] + 10**6 if r[0] is not None else None, *r[1:]) for r in AWKWARD], SCHEMA)
    folder = written(spark, str(tmp_path / "sf"), plain.unionByName(odd, allowMissingColumns=True))
    got = pipeline.run_stages(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder, str(tmp_path / "stages"))
    assert all(x.columns == list(pipeline.COLUMNS) for x in got[:-1])
    counts = [x.count() for x in got]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    seen = collections.Counter(json.dumps([r.doc_id, r.text]) for r in got[2].where("doc_id is not null and text is not null and text <> ''").collect())
    assert max(seen.values()) == 1  # repeated rows are one


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = written(spark, str(tmp_path / "sf"), spark.read.parquet(f"{SF}/documents.parquet").where("false"))
    assert pipeline.run(spark, folder).count() == 0
