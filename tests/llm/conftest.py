import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string"


@pytest.fixture
def table_of(spark, tmp_path):
    """A function that writes rows (doc_id, text[, source]) as the table documents of a folder, with a
    column of a clashing name, and returns the folder; further tables by name."""

    def make(rows, **more):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x") for r in rows]
        spark.createDataFrame(full, DOCS).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        for name, (data, schema) in more.items():
            spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make
