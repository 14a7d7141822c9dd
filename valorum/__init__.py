"""valorum: equity fundamentals and dividend valuation as Spark DataFrame operators.

Sub-packages:

* ``functions``  Column expressions (text folding, value rules, classification).
* ``operators``  table-in / table-out operators (resolution, latest-per-key,
  assumptions, quotes, valuation, state maintenance, quality reports).
* ``sources``    readers and writers for the landing formats.
* ``streaming``  Structured Streaming jobs for arriving quotes and assumptions.
* ``plans``      demo plans over the test tables and their DuckDB oracles.
"""

from valorum.session import build_session, ensure_checkpoint_dir, shared_path

__all__ = ["build_session", "ensure_checkpoint_dir", "shared_path"]
