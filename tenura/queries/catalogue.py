"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from tenura.queries import (  # noqa: F401
    audits,
    data_quality,
    decisions,
    evaluation,
    exploration,
    feature_engineering,
    modelling,
    service,
)
from tenura.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
