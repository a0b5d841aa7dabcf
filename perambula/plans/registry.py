"""Name to query and name to oracle SQL; the plan modules add theirs when they are imported below."""

QUERIES: dict = {}
ORACLES: dict = {}

from perambula.plans import hashes, labels, mobility, sources, wide  # noqa: E402, F401
