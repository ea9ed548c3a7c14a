"""Ready-made runs of every operator over the standard tables.

``QUERIES[name](spark, folder)`` returns a DataFrame; ``ORACLES[name]`` is the same
result as SQL over the tables themselves, where SQL can express it.
"""

from . import clustering, graphs, lines, pages, runs, tables, training  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
