"""Each operator and stage over odd rows and over an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesselon.llm import gif, html, licences, mixing, passages, pieces, quality, secrets, simhash, vectors
from tesselon.llm.entries import PIECES


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (5, None, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")


def domains(docs):
    return docs.select("doc_id", F.col("lang").alias("domain"))


OPERATORS = {
    "pieces": lambda d: pieces.with_pieces(d, PIECES),
    "passages": passages.without_repeats,
    "mixing": lambda d: mixing.mixed(d, domains(d), {"en": 0.5, "de": 0.3, "xx": 0.2}),
    "media": lambda d: gif.media_digest(gif.text_media(d)),
    "simhash": simhash.simhash_groups,
    "secrets": secrets.secret_report,
    "redacted": secrets.redacted,
    "licences": licences.licences,
    "quality": lambda d: quality.quality(d, labels(d.sparkSession)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_each(odd_docs, name):
    rows = OPERATORS[name](odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_docs.collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(no_docs, name):
    assert OPERATORS[name](no_docs).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, odd_docs, no_docs, k):
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, odd_docs, "/root/testdata/sf0.001")
    if k + 1 < len(corpus_pipeline.STAGES):
        assert out.columns == corpus_pipeline.COLUMNS
    out.collect()
    assert stage(spark, no_docs, "/root/testdata/sf0.001").count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [-0.0, 3.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("raw", F.lit(1)).withColumn("cls", F.lit(2))
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect())
    assert got == sorted([
        ("1", 2, 1, True), ("2", 2, 1, False), ("None", 2, 1, True), ("2", 1, 2, True), ("10", 1, 2, False),
        *[(str(i), 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)],
    ])
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<p>Only a paragraph that says something of its own.</p>"), (3, "u", "<p>a" * 3000), (3, "u", "<p>a" * 3000), (4, "u", "<<<>>> & &#x41; &bogus; </div><p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = html.page_texts(df).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert html.page_texts(df.limit(0)).count() == 0
