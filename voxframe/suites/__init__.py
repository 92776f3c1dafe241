"""Query suites over the test tables, one module per family of operators."""

from . import counts, drift, models, more, rows, stages  # noqa: F401
