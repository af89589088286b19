"""The pipeline's stages on the small tables, each against a plain version of what it keeps."""

import pytest
from pyspark.sql import functions as F
from test_training_data import DATA, brute_components, brute_passages, brute_sets, plain_mix, whole_ids

from palimpsest.llm.mixing import BLOCK

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r for r in rows}
            assert len(after) == len(rows)
        if name == "toxicity":
            assert len(before) - len(after) < 0.4 * len(before)
            assert len(toxic & set(after)) < len(toxic)
        if name == "near_duplicates":
            ids = sorted(before)
            want = brute_components(ids, brute_sets([before[i]["text"] for i in ids]))
            assert set(after) == {i for i, c in zip(ids, want, strict=True) if i == c}
        if name == "repeats":
            ids = sorted(before)
            want = brute_passages([before[i]["text"] for i in ids], corpus_pipeline.PASSAGE, corpus_pipeline.WORDS)
            assert set(after) == set(before) and any(want)
            for i, gone in zip(ids, want, strict=True):
                size = len((before[i]["text"] or "").encode())
                assert size - gone - 8 <= len((after[i]["text"] or "").encode()) <= size - gone
                assert gone or after[i] == before[i]
        if name == "mixing":
            assert after == before
            order = [r["doc_id"] for r in stage(spark, docs, DATA).collect()]
            places = plain_mix([{"doc_id": i, "source": r["source"]} for i, r in before.items()], corpus_pipeline.TARGETS, 1.0, BLOCK)
            assert [before[i]["source"] for i in order] == [before[i]["source"] for i in sorted(places, key=lambda i: places[i][4])]
        if name == "packing":
            ids = sorted(before)
            assert {r["doc_id"]: r["doc_tokens"] for r in rows} == dict(zip(ids, map(len, whole_ids([before[i]["text"] for i in ids])), strict=True))
        else:
            docs, before = out, after


def test_the_order_of_mixing_outlives_its_files(spark, tmp_path):
    from palimpsest.llm.mixing import mixed_order

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.mixing(spark, docs, DATA)
    want = [r["doc_id"] for r in out.collect()]
    out.repartition(7, "lang").write.parquet(str(tmp_path / "mixed"))  # another order, in files of other sizes
    again = spark.read.parquet(str(tmp_path / "mixed"))
    assert [r["doc_id"] for r in again.collect()] != want
    assert [r["doc_id"] for r in mixed_order(again, corpus_pipeline.TARGETS, other=1.0).collect()] == want


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2 + [(1, None, None, "s", 0), (2, "", "en", None, 0), (3, "  ", "en", "s", 2), (4, "one two", "en", "s", 7), (4, "one two", "en", "s", 7)]])
def test_odd_tables_pass_through_all_stages(spark, tmp_path, rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows} and all(r["length"] > 0 for r in got)
    assert {r["doc_id"]: r["doc_tokens"] for r in got if r["doc_id"] in (1, 2)} == ({1: 1, 2: 1} if rows else {})


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    # Where a piece is packed depends on the input's splits; which pieces of ids there are, put together, doesn't.
    tokens = lambda df: sorted((r["doc_id"], r["doc_tokens"], r["n"]) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect())
    got = tokens(corpus_pipeline.run(spark, DATA))
    assert got == tokens(docs) and all(n == total for _, total, n in got)
