"""The driver contract."""

import __spark_entry__ as entry
from tesselon.catalog import QUERIES


def test_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["image_id", "label", "labels", "score"]
    assert df.count() > 0


def test_core_does_not_import_the_corpus_operators():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "tesselon"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tesselon.llm" not in path.read_text(), path
