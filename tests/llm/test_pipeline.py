"""The pipeline's stages on the smallest tables, and the registered queries."""

from __future__ import annotations

import corpus_pipeline
from helpers import FOLDER, awkward, prose, shingle_set, words_of

from rankloom.llm.common import DOCUMENT_COLUMNS, read
from rankloom.llm.queries import CATALOG


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in CATALOG.queries) == list(range(1, 14))


def test_stages_hand_on_what_they_keep(spark, tmp_path):
    docs = read(spark, FOLDER, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept = docs.collect()
        assert {r["doc_id"] for r in kept} <= set(before)
        if number < 4:
            assert tuple(docs.columns) == DOCUMENT_COLUMNS
        if number == 0:
            assert len(kept) > 0.7 * len(before) and all(len(words_of(r["text"])) >= 10 for r in kept)
        if number == 2:
            sets = [shingle_set(r["text"]) for r in kept]
            assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)))
        before = {r["doc_id"]: r["text"] for r in kept} if number < 4 else before
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in kept)
    assert len(kept) == spark.read.parquet(f"{tmp_path}/3").count()


def test_run_hands_tables_from_stage_to_stage(spark, tmp_path):
    """Awkward rows pass all stages: junk goes, one of equal texts stays, clashing columns change nothing, an empty table gives no rows."""
    texts = [prose(k, 60) for k in range(12)] + [prose(0, 60), prose(1, 60) + " end"]
    awkward(spark, texts).write.parquet(f"{tmp_path}/some/documents.parquet")
    awkward(spark).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels = spark.createDataFrame([(100 + k, 1, 0) for k in range(6)], "doc_id long, quality int, toxic int")
    for folder in ("some", "none"):
        labels.write.parquet(f"{tmp_path}/{folder}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()}
    assert kept and kept <= set(range(100, 112)) and 112 not in kept
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
