import inspect
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import op2_jaccard, op4_mix, op7_bpe, op9_toxicity, op10_repeats
from tests_llm_util import words

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, rows = [], docs
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        before = rows
        rows = spark.createDataFrame((out := stage(spark, rows, SF)).collect(), out.schema)
        sizes.append((name, rows.count()))
        if name != "encoding":
            assert rows.columns == docs.columns
        if name == "toxicity":
            model = op9_toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            clean = {r.doc_id for r in op9_toxicity.score(before, model).filter("score < 0.5").collect()}
            assert {r.doc_id for r in rows.collect()} == clean
        if name == "near_duplicates":
            assert {r.doc_id for r in rows.collect()} == {r.class_id for r in op2_jaccard.classes(before).collect()}
        if name == "repeats":
            assert op10_repeats.passages(rows).count() <= op10_repeats.passages(before).count()
        if name == "mixing":
            taken = {r.doc_id: r.copies for r in op4_mix.mix(before).collect() if r.copies}
            assert {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()} == taken
    assert [n for n, _ in sizes] == ["toxicity", "near_duplicates", "repeats", "mixing", "encoding"] and sizes[-1][1] > 0


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == op7_bpe.digests(spark.read.parquet(f"{SF}/documents.parquet")).columns and got.count() > 0


def test_empty(spark, docs):
    rows = docs([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        assert out.count() == 0
        rows = spark.createDataFrame([], out.schema)


def test_null_and_repeated_ids_and_clashing_columns(spark, docs):
    """Every stage on rows without ids, ids of several texts, equal rows, odd texts and names the stages use."""
    rng = random.Random(15)
    passage = words(rng, 60)
    rows = [(None, f"{words(rng, 12)}", "a") for _ in range(40)] + [(None, f"{passage} {words(rng, 20)}", "b"), (None, f"{passage} {words(rng, 30)}", None), (None, None, None), (None, "", "a")]
    rows += [(1, words(rng, 30), "a"), (1, words(rng, 30), "b"), (2, passage, "a"), (2, passage, "a"), (3, "x" * 4000, "b"), (4, words(rng, 9000), None)]
    made = docs(rows)
    for name in ("_id", "_kept", "_spans", "_copies", "row", "id", "key", "text_hash", "spans", "worst", "of_id"):
        made = made.withColumn(name, F.lit("z"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, made, SF)
        got = out.collect()
        if name == "encoding":
            assert len(got) == len(rows)
            continue
        assert out.columns == made.columns and all(r["_id"] == r["worst"] == "z" for r in got)
        texts = [r.text for r in got]
        if name == "near_duplicates":
            assert len(got) == len(rows) - 1 and sorted(r.doc_id or 0 for r in got if r.doc_id) == [1, 1, 2, 3, 4]
        if name == "repeats":
            assert sum((t or "").split().count(passage.split()[0]) >= 1 and passage in (t or "") for t in texts) == 1 + (texts.count(passage) == 2)
        if name == "mixing":
            assert None in texts and "" in texts
    model = op9_toxicity.Model(np.zeros(op9_toxicity.CODES), -1.0, 1.0, 0.5)
    assert op9_toxicity.keep_clean(made, model).count() == len(rows)
