"""spendtrace: cost and latency analytics for AI services, on Spark DataFrames.

Sources turn raw logs into typed frames, operators turn frames into reports,
plans chain both into jobs, and ``streaming`` runs the same work incrementally.
Every public function takes and returns lazy DataFrames.
"""

__version__ = "0.1.0"
