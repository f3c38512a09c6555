"""agentlake — Spark-native analytics over AI-agent traffic.

Every operator is a ``DataFrame -> DataFrame`` function built from Catalyst
expressions; keyed ordered folds (guardian, execution state machine) run as
sorted per-partition ``mapInPandas`` scans after a keyed shuffle, and share
their step functions with the Structured Streaming drivers.
"""

from agentlake.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
