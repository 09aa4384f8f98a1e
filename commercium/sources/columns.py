"""Column names of incoming tables: normalise, resolve aliases, validate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted spellings per canonical order column, first match wins.
ORDER_ALIASES: dict[str, list[str]] = {
    "order_date": ["order_date", "date", "orderdate"],
    "sku": ["sku", "product_sku", "product_id", "product"],
    "quantity": ["quantity", "qty", "order_quantity", "units"],
    "net_price": ["net_price", "netprice", "selling_price", "price", "sell_price"],
    "list_price": ["list_price", "listprice", "list_price_per_unit"],
    "discount_pct": ["discount_pct", "discount", "discount_percent"],
    "business_unit": ["business_unit", "businessunit", "business_unit_name"],
    "region": ["region"],
    "channel": ["channel"],
    "customer_tier": ["customer_tier", "customer_segment", "tier"],
}

ORDER_REQUIRED = ["order_date", "sku", "quantity", "net_price"]


def normalise_names(df: DataFrame) -> DataFrame:
    """Trim, lower-case and underscore every column name."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise naming every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; available: {df.columns}")
    return df


def resolve_aliases(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str] = ()
) -> DataFrame:
    """Rename the first alias present to its canonical name; keep other columns."""
    found = {
        canonical: next((a for a in spellings if a in df.columns), None)
        for canonical, spellings in aliases.items()
    }
    missing = [c for c in required if found.get(c) is None]
    if missing:
        expected = {c: list(aliases.get(c, [])) for c in missing}
        raise ValueError(f"missing required columns: {expected}; available: {df.columns}")
    return df.withColumnsRenamed({a: c for c, a in found.items() if a is not None})


def canonical_columns(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]] = ORDER_ALIASES,
    required: Sequence[str] = ORDER_REQUIRED,
) -> DataFrame:
    """Normalise names, resolve aliases and project the canonical columns found."""
    resolved = resolve_aliases(normalise_names(df), aliases, required)
    return resolved.select(*[F.col(c) for c in aliases if c in resolved.columns])
