import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Build a frame from rows and a schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


LONG = "word " * 60_000
AWKWARD = [None, "", "   ", "​­", "n/a", "é" * 5000, LONG, "👩‍👧 ok", "\x00\x01", "<|endoftext|>", "ＡＢ"]


@pytest.fixture(scope="session")
def awkward():
    """Texts that must not break anything: null, empty, blank, invisible, very long."""
    return AWKWARD
