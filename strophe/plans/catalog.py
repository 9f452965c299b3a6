"""The queries of the core operators, and their SQL."""

from strophe.plans import arrays, baseline, pipelines, text  # noqa: F401  (they register their queries)
from strophe.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
