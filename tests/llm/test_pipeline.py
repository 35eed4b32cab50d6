"""The pipeline's stages against brute force over a small table."""

import collections

import pytest

import corpus_pipeline as P
from pulseframe.llm import quality
from test_corpus import SCHEMA, brute_components, brute_lines, by_id, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(corpus(9), SCHEMA).write.parquet(f"{out}/documents.parquet")
    return str(out)


def test_stages_do_what_they_say(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        after = [tuple(r) for r in out.collect()]
        if name == "quality_rules":
            assert by_id(after) == by_id(r for r in before if quality.first_rejection(quality.Text(r[1]), list(quality.BASE + quality.RULES)) is None)
        if name == "line_dedup":
            assert by_id((r[0], r[1]) for r in after) == by_id((x[0], x[3]) for x in brute_lines(before))
            assert all(r[4] == len(r[1]) for r in after if r[1] is not None)
        if name == "near_copies":
            first = {(i, c) for i, _, c in brute_components(before, 5, 80)}
            assert by_id(after) == by_id(r for r in before if r[0] is None or (r[0], r[0]) in first)
        if name == "source_mix":
            n = collections.Counter(r[0] for r in after)
            assert max(n.values()) <= 3 * max(collections.Counter(r[0] for r in before).values())
        if name == "packing":
            tokens = collections.Counter()
            for r in out.collect():
                tokens[r.sequence_id] += r.length
            assert all(t <= 4096 for t in tokens.values())
        docs, before = spark.createDataFrame(after, out.schema) if name != "packing" else out, after


def test_the_whole_run(spark, folder):
    assert P.run(spark, folder).count() > 0
