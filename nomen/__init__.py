"""nomen — organisation-name resolution as Spark DataFrame operators.

Subpackages:

* ``functions`` — ``Column -> Column`` builders (name normalisation, variations,
  scores, text helpers). Built-in Spark expressions only.
* ``operators`` — ``DataFrame -> DataFrame`` operators (owner classification,
  page extraction, report parsing, blocked match join, numbering, stats).
* ``sources`` / ``sinks`` — readers and writers (GeoJSON, pages, text reports,
  CSV summaries, JSON records).
* ``streaming`` — Structured Streaming forms of the page parser and dedupe.
* ``plans`` — composed pipelines and the inputs derived from the test tables.
"""

from nomen.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
