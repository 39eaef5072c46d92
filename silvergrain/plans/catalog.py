"""Imports every plan module, so that the registry is full."""
from silvergrain.plans import oracle_views  # noqa: F401  (views first: plans refer to them)
from silvergrain.plans import browse, bursts, heroes, ingest, places, reports, scores, streams  # noqa: F401
