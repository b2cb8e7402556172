"""Connected components: those of the library."""

from caseloom.operators.keyed import components

__all__ = ["components"]
