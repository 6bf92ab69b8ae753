"""Each stage of the pipeline on the small corpus, against plain Python on the stage's own input."""

import corpus_pipeline
import public_tokenizers as P
from pyspark.sql import functions as F

from sightline.llm import byte_bpe
from sightline.llm.decontaminate import tokens
from tests.llm.test_dedup import brute_lines, components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        if name != "byte_bpe":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
        if name == "line_dedup":
            assert sorted(after.items()) == [(i, t) for i, _, _, t in brute_lines(list(before.items()))]
        elif name == "near_dedup":
            assert sorted(after) == [i for i, _, _, kept in components(list(before.items()), 5) if kept]
        elif name == "decontamination":
            items = [tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            whole = lambda t: any(" ".join(w) in " ".join(tokens(t)) for w in items)
            assert not any(whole(t) for t in after.values()) and set(before) - set(after) >= {i for i, t in before.items() if whole(t)}
        elif name == "byte_bpe":
            want = {r.doc_id: r.n_tokens for r in byte_bpe.encode_decode(spark.createDataFrame(list(before.items()), "doc_id bigint, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
            assert {r.doc_id: r.n_tokens for r in docs.collect()} == want


def test_documents_stay_without_labels(spark, tmp_path):
    d = spark.createDataFrame([(1, "a clean text"), (2, ""), (3, None)], "doc_id bigint, text string")
    labels = "doc_id bigint, quality int, toxic int"
    spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/none/labels.parquet")
    # These meet no document.
    spark.createDataFrame([(70, 1, 1), (71, 1, 0)], labels).write.parquet(f"{tmp_path}/others/labels.parquet")
    for name in ("none", "others"):
        assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, d, f"{tmp_path}/{name}").collect()} == {1, 2, 3}


def test_documents_without_evidence_stay_with_few_labels(spark, tmp_path):
    """Fewer than 10 labels, half of them toxic: no calibration, and the prior is above the threshold."""
    rows = [(i, "vile fool" if i < 4 else "ripe tomatoes") for i in range(8)] + [(8, "unheard words")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    spark.createDataFrame([(i, 1, int(i < 4)) for i in range(8)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, d, str(tmp_path)).collect()} == {4, 5, 6, 7, 8}
