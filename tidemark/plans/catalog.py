"""All toolkit queries."""

from . import q_models, q_ridge, q_series, q_tables  # noqa: F401  register on import
from .registry import QUERIES, SQL  # noqa: F401
