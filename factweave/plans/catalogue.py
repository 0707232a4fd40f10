"""All catalogue queries: importing the q_ modules fills the registry."""

from . import q_documents, q_export, q_labels, q_linking, q_statements, q_stores, q_streams, q_text  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
