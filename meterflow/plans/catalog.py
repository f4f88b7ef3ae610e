"""All registered queries; importing this module fills the registry."""

from meterflow.plans import (  # noqa: F401
    catalog_alerts,
    catalog_api,
    catalog_measure,
    catalog_slices,
    catalog_sources,
    catalog_streams,
)
from meterflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
