"""Raw text to the typed, enriched account table: one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tenura.operators import features, quality
from tenura.params import MISSING_MARKERS
from tenura.plans.raw import NUMBERS


def build_gold(
    raw: DataFrame,
    catalogue: DataFrame,
    numeric: tuple[str, ...] = NUMBERS,
    dates: tuple[str, ...] = ("date_souscription",),
    check_key: str | None = None,
) -> DataFrame:
    """Markers, copies, numbers, dates, clips, features, catalogue, sector, country.

    With `check_key` the key is verified by an action before anything is built on it.
    """
    cleaned = quality.drop_exact_duplicates(quality.null_out_markers(raw, MISSING_MARKERS))
    if check_key is not None:
        quality.assert_unique_key(cleaned, check_key)
    typed = quality.parse_dates(quality.coerce_numeric_columns(cleaned, numeric), dates)
    capped = quality.cap_impossible_values(typed, positive=())
    return features.request_features(capped, catalogue)
