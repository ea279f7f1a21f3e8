"""Every registered query beside the SQL that must give the same rows."""

from . import analysis, features, learning, operations, quality, streams  # noqa: F401
from .registry import CATALOG

__all__ = ["CATALOG"]
