"""Named queries over the test tables, one module per area."""

from sievemill.queries.registry import ORACLES, QUERIES  # noqa: F401
from sievemill.queries import cleaning, machine, patterns, privacy, profiling, relational, rules, synthesis, telemetry, usage  # noqa: F401
