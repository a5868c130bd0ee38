"""Variables of the institution panel: canonical order, sources' names, codes."""

from __future__ import annotations

# Canonical variables in order.
CANONICAL = (
    "retention_ft", "grad_rate_6yr", "grad_rate_6yr_pell", "grad_rate_6yr_nonpell", "pct_part_time", "pct_pell",
    "pct_international", "pct_white", "pct_black", "pct_hispanic", "pct_asian", "pct_aian", "pct_nhpi",
    "pct_two_or_more", "pct_unknown", "pct_minority", "net_price_0_30k", "net_price_30_48k", "net_price_48_75k",
    "net_price_75_110k", "net_price_110k_plus", "sat75_reading", "sat75_math", "sat75_writing", "act75_cumulative",
    "act75_english", "act75_math", "act75_writing", "acceptance_rate", "median_debt", "cost_attendance",
    "tuition_in_state", "tuition_out_of_state", "avg_net_price_public", "avg_net_price_private", "ug_size",
)

# The first source's names that differ from the canonical ones.
RENAMED = {
    "retention_ft_4yr": "retention_ft", "grad_rate_pell": "grad_rate_6yr_pell", "grad_rate_nonpell": "grad_rate_6yr_nonpell",
    "race_white": "pct_white", "race_black": "pct_black", "race_hispanic": "pct_hispanic", "race_asian": "pct_asian",
    "race_aian": "pct_aian", "race_nhpi": "pct_nhpi", "race_two_or_more": "pct_two_or_more", "race_unknown": "pct_unknown",
}

# Entities in scope, the constant denominator of coverage.
UNIVERSE = 1249

# Control codes, income band codes.
CONTROL = {1: "Public", 2: "Private"}
INCOME_BANDS = {1: "net_price_0_30k", 2: "net_price_30_48k", 3: "net_price_48_75k", 4: "net_price_75_110k", 5: "net_price_110k_plus"}


def first_source_map() -> dict[str, str]:
    """Names of the first source to canonical names: renamed ones, and the canonical names it uses itself."""
    renamed = set(RENAMED.values())
    return RENAMED | {v: v for v in CANONICAL if v not in renamed and v != "pct_minority"}


def second_source_map() -> dict[str, str]:
    """The second source knows the first 21 canonical variables by their canonical names."""
    return {v: v for v in CANONICAL[: CANONICAL.index("sat75_reading")]}


def kind(variable: str) -> str:
    """percent, currency, rank or number, by the form of the name."""
    if variable.startswith(("net_price", "tuition", "cost", "median_debt", "avg_net_price")):
        return "currency"
    if variable.startswith(("pct_", "retention", "grad_rate", "acceptance")):
        return "percent"
    return "rank" if variable.endswith("rank") else "number"
