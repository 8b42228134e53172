"""Location attributes derived from state and city.

The lookups are fixed and tiny, so they are literals in the projection: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_values as fv


def state_code(state: Column, codes: Mapping[str, str] = fv.STATE_CODES) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.try_element_at(lookup, state)


def is_union_territory(state: Column, territories: Sequence[str] = tuple(fv.UNION_TERRITORIES)) -> Column:
    return F.coalesce(state.isin(list(territories)), F.lit(False))


def is_capital(
    state: Column, city: Column, capitals: Sequence[tuple[str, str]] = tuple(fv.CAPITAL_CITIES)
) -> Column:
    pairs = [F.struct(F.lit(s).alias("state"), F.lit(c).alias("city")) for s, c in capitals]
    return F.coalesce(F.struct(state.alias("state"), city.alias("city")).isin(pairs), F.lit(False))


def city_tier(
    city: Column,
    tier_1: Sequence[str] = tuple(fv.TIER_1_CITIES),
    tier_2: Sequence[str] = tuple(fv.TIER_2_CITIES),
) -> Column:
    return (
        F.when(city.isin(list(tier_1)), F.lit("Tier-1"))
        .when(city.isin(list(tier_2)), F.lit("Tier-2"))
        .otherwise(F.lit("Tier-3"))
    )


def rewrite_state(state: Column, rewrites: Mapping[str, str] = fv.STATE_REWRITES) -> Column:
    result = state
    for old, new in rewrites.items():
        result = F.when(state == old, F.lit(new)).otherwise(result)
    return result


def enrich_location(
    df: DataFrame,
    states: Mapping[str, str] = fv.STATE_CODES,
    capitals: Sequence[tuple[str, str]] = tuple(fv.CAPITAL_CITIES),
    territories: Sequence[str] = tuple(fv.UNION_TERRITORIES),
    tiers: tuple[Sequence[str], Sequence[str]] = (tuple(fv.TIER_1_CITIES), tuple(fv.TIER_2_CITIES)),
) -> DataFrame:
    """Adds code, flags and tier; all of them read the state as delivered, before its rewrite."""
    state, city = F.col("state"), F.col("city")
    return df.withColumns(
        {
            "state_code": state_code(state, states),
            "is_union_territory": is_union_territory(state, territories),
            "capital_city_flag": is_capital(state, city, capitals),
            "city_tier": city_tier(city, *tiers),
            "state": rewrite_state(state),
        }
    )
