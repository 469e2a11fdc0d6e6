"""Genomic-surveillance analytics as plain PySpark DataFrame operators.

Every operator is a function ``f(tables, **params) -> DataFrame`` (or, for ingest,
``f(dataframes..., **params) -> DataFrame``) that only builds a plan.  See ``README.md``.
"""

from virosieve.session import configure, local_session
from virosieve.tables import Tables

__all__ = ["Tables", "configure", "local_session"]
