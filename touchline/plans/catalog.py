"""All registered queries of the league library."""

from touchline.plans import flagship, q_clean, q_features, q_market, q_models, q_resolve, q_scoring, q_sources, q_squad  # noqa: F401  they register themselves
from touchline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
