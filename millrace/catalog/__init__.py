"""All queries over the driver's tables, with the equal SQL."""

from . import basic, cleaning, features, profiling, workflow  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
