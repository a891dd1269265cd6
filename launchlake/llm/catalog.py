"""All registered queries of this subpackage."""

from launchlake.llm import queries  # noqa: F401
from launchlake.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
