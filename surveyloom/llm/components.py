"""Connected components, as the library's graph operators find them."""

from ..operators.graph import components

__all__ = ["components"]
