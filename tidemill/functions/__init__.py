"""Column functions that the tables and queries share."""

from .scalar import *  # noqa: F403
