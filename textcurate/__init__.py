"""textcurate: labelled short-text curation and evaluation on Spark.

Everything is expressed as DataFrame operations and Column expressions so that
Catalyst plans it and whole-stage codegen runs it; Python runs inside tasks only
for pluggable batch scorers (Arrow-batched pandas UDFs).
"""

from textcurate.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
