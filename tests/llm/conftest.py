import pathlib

import pytest

DATA = pathlib.Path("/root/testdata")


@pytest.fixture(scope="session")
def tiny():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.01")


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) pairs."""

    def make(rows, extra=()):
        schema = "doc_id bigint, text string" + "".join(f", {c} string" for c in extra)
        return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)

    return make
