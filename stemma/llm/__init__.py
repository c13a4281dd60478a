"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

from ._components import components as components_of
from ._tables import clear_tables

__all__ = ["clear_tables", "components_of"]
