"""Importing the modules below registers the corpus queries."""

from trustweave.llm import query_rows, query_text  # noqa: F401
from trustweave.llm.query_registry import ORACLES, QUERIES  # noqa: F401
