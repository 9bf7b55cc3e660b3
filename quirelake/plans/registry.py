"""All queries over the supplied tables."""

from __future__ import annotations

from . import books, joins, outlines, positions, streams, texts, upkeep  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401
