"""All query modules, imported for their registrations."""

from gaugework.plans import (  # noqa: F401
    identity,
    ingestion,
    integrity,
    preparation,
    profiles,
    scoring,
    statistics,
)
from gaugework.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
