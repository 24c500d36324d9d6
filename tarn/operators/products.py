"""Product and model names: canonical slugs, typed synonyms, display names, providers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names by slug, typed names by slug, and what tickets call their project.
DISPLAY = {"api": "API", "tradedesk": "TradeDesk", "saleshub": "SalesHub", "formflow": "FormFlow", "web2": "Web2", "web4": "Web4", "other": "Other"}
SYNONYMS = {"formflow": "formflow", "saleshub": "saleshub", "tradedesk": "tradedesk", "td": "tradedesk", "web2": "web2", "web4": "web4", "api": "api", "other": "other"}
PROJECTS = {
    "td client server": "tradedesk", "business modeling": "tradedesk", "td web api": "api", "rest api": "api", "td web portal v4.0": "web4",
    "td web portal v2.0": "web2", "td web portal v1": "web2", "formflow": "formflow", "saleshub": "saleshub",
}


def looked_up(name: Column, values: dict[str, str]) -> Column:
    """The value of a name; null for names without one."""
    if not values:
        return F.lit(None).cast("string")
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[name]


def _typed(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""))


def resolve(name: Column) -> Column:
    """The slug of a typed product name or synonym, in any case; null if there is none."""
    return looked_up(_typed(name), SYNONYMS)


def of_project(name: Column) -> Column:
    """The slug of a ticket's project; ``other`` for unknown and null ones."""
    return F.coalesce(looked_up(_typed(name), PROJECTS), F.lit("other"))


def display(slug: Column, names: dict[str, str] | None = None) -> Column:
    """The display name; names without one are shown as they are, null as empty."""
    return F.coalesce(looked_up(slug, DISPLAY if names is None else names), slug, F.lit(""))


def provider_of(model: Column, models: dict[str, list[str]]) -> Column:
    """The first provider that has a model; null for unknown models."""
    by: dict[str, str] = {}
    for provider, own in models.items():
        for m in own:
            by.setdefault(m, provider)
    return looked_up(model, by)
