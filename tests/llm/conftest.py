import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark, tmp_path):
    """Makes a stored documents table of (doc_id, text[, lang, source]) rows, with clashing extra columns."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            df = df.selectExpr("*", "'x' as uid", "1 as size", "'y' as fingerprint", "2.0 as score", "'z' as __note")
        path = str(tmp_path / f"documents-{len(list(tmp_path.iterdir()))}")
        df.repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make
