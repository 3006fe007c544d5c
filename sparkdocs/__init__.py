"""Document corpus engine on PySpark: ingest, merge, search and upkeep of a documents table."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from sparkdocs.operators.search import SearchParams, search, search_info  # noqa: E402
from sparkdocs.session import build_session, cut_lineage, prepare  # noqa: E402

__all__ = ["SearchParams", "build_session", "cut_lineage", "prepare", "search", "search_info"]
