"""All queries of the reference's own operators, and their oracles."""

from quire.plans import content as _content  # noqa: F401
from quire.plans import entries as _entries  # noqa: F401
from quire.plans import files as _files  # noqa: F401
from quire.plans import grids as _grids  # noqa: F401
from quire.plans import pages as _pages  # noqa: F401
from quire.plans import rules as _rules  # noqa: F401
from quire.plans import sync as _sync  # noqa: F401
from quire.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
