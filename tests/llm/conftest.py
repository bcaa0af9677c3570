from __future__ import annotations

import os

os.environ.setdefault("OMP_NUM_THREADS", "1")  # before numpy: as Spark sets it for its workers

import pytest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """doc_id and text of the small table."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


@pytest.fixture()
def frame(spark):
    """A table of (doc_id, text) with a clashing extra column."""
    def build(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_words string")
    return build
