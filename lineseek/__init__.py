"""Profile JSON-lines collections and search them with hybrid ranking, on Spark.

Three entry points cover the everyday work:

* :func:`analyze`      - field statistics of a JSON-lines collection
* :func:`build_index`  - documents, vectors and postings as Parquet tables
* :func:`search_index` - ranked results for a whole table of queries

Everything below them is a plain ``DataFrame -> DataFrame`` or
``Column -> Column`` function and can be used on its own.
"""

from lineseek.plans.analyze import Analysis, analyze
from lineseek.plans.build import build_index, index_tables
from lineseek.plans.search import search, search_index

__all__ = ["Analysis", "analyze", "build_index", "index_tables", "search", "search_index"]
