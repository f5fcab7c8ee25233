"""Submission analytics on Spark.

Every operator is a function ``f(df, ...) -> DataFrame`` built from Catalyst
expressions, so the same code serves batch jobs and Structured Streaming.
"""

from scrivener.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
