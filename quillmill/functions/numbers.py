"""Arithmetic of costs and quotas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quota(n: int, weight: float) -> int:
    """At least three; halves go to the even number."""
    return max(3, round(n * weight))


def import_cost(price: Column, shipping: Column, rate: Column) -> dict[str, Column]:
    """Duty of 6 % on price and shipping and tax of 19 % on both, from a price of 41 on."""
    cif, taxed = price + shipping, price >= 41.0
    duty = F.when(taxed, cif * 0.06).otherwise(0.0)
    tax = F.when(taxed, (cif + duty) * 0.19).otherwise(0.0)
    total = cif + duty + tax
    return {"cif_usd": cif, "duty_usd": duty, "tax_usd": tax, "total_usd": total, "total_local": total * rate, "is_taxed": taxed}


def token_cost(used_in: Column, used_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million; an unknown model costs nothing."""
    return F.round((used_in * F.coalesce(price_in, F.lit(0.0)) + used_out * F.coalesce(price_out, F.lit(0.0))) / 1e6, 6)
