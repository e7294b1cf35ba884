"""Named queries over the domain views, with their SQL where SQL can say it."""

from wayfold.plans import curation, extras, gaps, payloads, retrieval, signals  # noqa: F401  they register their queries
from wayfold.plans.registry import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
