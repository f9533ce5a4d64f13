"""All registered queries of the register, extraction and streaming operators, and their SQL."""

from __future__ import annotations

from . import page_queries, register_queries, scalar_queries, version_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
