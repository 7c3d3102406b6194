"""The pipeline's stages on a small corpus with planted cases."""

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_repeats, words
from veilspark.llm import sentencepiece_bpe
from veilspark.llm.runtime import cut

ITEM = "what is the first of these ten or more words here that a test holds"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    passage = words(70, 900)
    rows = [(k, words(80, k, 3000), ("en", "de")[k % 2], f"s{k}", 1) for k in range(40)]
    rows += [(50, rows[3][1], "de", "s", 1), (51, rows[4][1] + " z", "en", "s", 1), (52, passage + " " + words(40, 52, 3000), "en", "s", 1), (53, words(40, 53, 3000) + "\n" + passage, "en", "s", 1)]
    rows += [(60, None, "en", "s", 1), (61, "12 34 !", None, "s", 1), (62, "", "en", None, 1), (63, words(40, 63, 3000) + " " + ITEM.upper() + " " + words(30, 64, 3000), "en", "s", 1), (64, ITEM, "en", "s", 1)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, folder))
        assert docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    identified, unique, cleaned, clean = seen
    assert set(identified) == {r[0] for r in rows} - {60, 61, 62}
    assert set(unique) == {k for k, _, c, kept in brute_components([(r.doc_id, r.text) for r in identified.values()], 5, 80) if kept} == set(identified) - {50, 51}
    assert set(cleaned) == set(unique)
    want = brute_repeats([(r.doc_id, r.text) for r in unique.values()], 50)
    assert {(d, n - gone) for d, n, gone, *_ in want} == {(d, len(r.text.encode())) for d, r in cleaned.items()}
    assert len(cleaned[53].text) < 0.6 * len(unique[53].text) and cleaned[52].text == unique[52].text
    assert set(clean) == set(cleaned) - {64} and ITEM.upper() not in clean[63].text and clean[63].text.startswith(words(40, 63, 3000))
    assert all(clean[k].text == r[1] for k, r in enumerate(rows[:40]))
    out = corpus_pipeline.run(spark, folder).collect()
    lib = sentencepiece_bpe.vocabulary(public_tokenizers.path("piece_bpe_32k.model")).lib
    assert {(r.doc_id, r.n_tokens) for r in out} == {(d, len(lib.encode(r.text)) + 2) for d, r in clean.items()}
    assert np.all([len(r.ids_sha256) == 64 for r in out])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_rows_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket string, ids int"
    rows = [(None, None, None, None, None, 1, "b", 2), (None, "some words without a number", "en", None, None, None, None, None), (3, "some words without a number", "en", None, None, None, None, None), (3, "some words without a number", "en", None, None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, " without a number"), (3, " without a number"), (3, " without a number")]
