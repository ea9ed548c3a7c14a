"""Shallow reconstruction: the line's gap texts with its regions left masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .template import follows, masked_text
from .walk import shallow_walk


def shallow_reconstruct(line: Column, pattern: Column) -> Column:
    """Rebuild a line from its pattern: gaps filled in, masks kept."""
    other = ~follows(line, pattern)
    walked = shallow_walk(F.when(other, line), F.when(other, pattern))
    return F.when(follows(line, pattern), masked_text(line, pattern)).otherwise(walked)
