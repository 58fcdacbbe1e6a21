"""The pipeline against a brute-force version of each stage, on all that the stage before it kept."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from casemill.llm import decontaminate, quality_classifier
from casemill.llm.queries import tokenizer_path

from .test_operators import SCHEMA, brute_components, brute_hits, brute_lines, corpus, ids_of, texts_of


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A directory with the three tables: the corpus, junk marked as poor and items taken from documents."""
    at = str(tmp_path_factory.mktemp("tables"))
    rows = corpus(2)
    junk = [(1000 + i, " ".join(f"{w}$$$" for w in f"junk {i} of no use at all here".split() * 6), "en", "s0", 0) for i in range(30)]
    spark.createDataFrame(rows + junk, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] % 2] + [(r[0], 0, 0) for r in junk if r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    long_ones = [r[1] for r in rows if r[1] and 60 < len(r[1].split()) < 100][:3]
    items = [(i, " ".join(t.split()[3:17])) for i, t in enumerate(long_ones)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outputs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        outputs.append(docs)
    start = texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ratings = quality_classifier.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality_classifier.grade_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), ratings).collect()
    good = {d: start[d] for d in (r["doc_id"] for r in judged if r["kept"])}
    assert texts_of(outputs[0]) == good
    assert not any(d >= 1000 for d in good)
    assert sum(d < 1000 for d in good) >= 0.95 * sum(d < 1000 for d in start)

    fewer = {d: t if good[d] is not None else None for d, t in brute_lines(good, 10, True).items()}
    assert texts_of(outputs[1]) == fewer

    parts = brute_components(fewer, 5, 80)
    single = {d: t for d, t in fewer.items() if parts[d][1] == d}
    assert texts_of(outputs[2]) == single

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_hits(single, items, 10)
    clean = {d: t for d, t in single.items() if not hits[d][4]}
    assert texts_of(outputs[3]) == clean
    assert len(clean) < len(single)

    pieces = defaultdict(list)
    for r in outputs[4].collect():
        pieces[r["doc_id"]].append(r)
    want = ids_of(tokenizer_path("byte_bpe_50k.json"), clean, 0)
    assert pieces.keys() == want.keys()
    for d, ids in want.items():
        own = sorted(pieces[d], key=lambda r: r["start"])
        assert np.array_equal(np.frombuffer(b"".join(r["ids"] for r in own), dtype="<u4"), ids)
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in own)
    for o in outputs[:4]:
        assert o.columns == spark.read.parquet(f"{sf_dir}/documents.parquet").columns


def test_run_is_the_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert decontaminate.item_words(None) == []


def test_empty_tables_and_odd_rows(spark, tmp_path):
    """Nothing in, nothing out; and rows without id or text, repeated rows and clashing columns go through every stage."""
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(40))
    one, hit = text(), text()
    rows = [(1, one), (1, one), (None, text()), (2, None), (3, ""), (4, hit), (4, text()), (5, "x " * 30_000)]
    schema = "doc_id long, text string, _doc int, fp string, label int, row int"
    for name, some in (("none", []), ("odd", [(*r, 1, "f", 0, 2) for r in rows])):
        at = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(None, hit)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs, columns = spark.read.parquet(f"{at}/documents.parquet"), None
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            stage(spark, docs, at).write.parquet(f"{at}/{i}")
            docs = spark.read.parquet(f"{at}/{i}")
            assert i == 4 or docs.columns == columns
        kept = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/3").collect()), key=str)
        assert kept == sorted([r for r in rows[1:] if r[1] != hit] if some else [], key=str)
        assert docs.where("start = 0").count() == len(kept)
