"""Who may see which hit.  Every filter closes when it knows nothing about the asker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rbac_filter(hits: DataFrame, permissions: DataFrame, allow: str | None = None) -> DataFrame:
    """``hits(role, ticker, ..)``; ``permissions(ticker, roles)``.

    ``allow`` names an array column of hits that, where not null, replaces the permissions.
    A ticker with no roles is open to everyone; ``admin`` sees all.
    """
    admin = F.col("role") == "admin"
    joined = hits.withColumn("_t", F.upper(F.coalesce("ticker", F.lit("")))).join(
        permissions.select(F.col("ticker").alias("_t"), F.col("roles").alias("_roles")), "_t", "left")
    open_to = F.coalesce(F.size("_roles") <= 0, F.lit(True)) | F.array_contains("_roles", F.col("role"))
    visible = open_to
    if allow:
        listed = F.array_contains(F.transform(F.col(allow), F.upper), F.col("_t"))
        visible = F.when(F.col(allow).isNotNull(), listed).otherwise(open_to)
    return joined.where(admin | F.coalesce(visible, F.lit(False))).drop("_t", "_roles")


def tenant_filter(hits: DataFrame, tenants: DataFrame) -> DataFrame:
    """``tenants(tenant_id, role, allowed_tickers)``; an unknown tenant sees nothing.

    Two semi joins: one on the tenant alone for admins, one on (tenant, ticker).
    """
    admins = tenants.where(F.col("role") == "admin").select("tenant_id")
    allowed = tenants.where(F.coalesce(F.col("role") != "admin", F.lit(True))).select(
        "tenant_id", F.explode(F.transform("allowed_tickers", F.upper)).alias("_t"))
    up = hits.withColumn("_t", F.upper(F.coalesce("ticker", F.lit(""))))
    by_ticker = up.where(F.col("_t") != "").join(allowed, ["tenant_id", "_t"], "left_semi")
    by_admin = up.join(admins, "tenant_id", "left_semi")
    return by_ticker.unionByName(by_admin).drop("_t")


def tenant_rbac_filter(hits: DataFrame, tenants: DataFrame, permissions: DataFrame) -> DataFrame:
    """The tenant's own list takes the place of the permissions."""
    known = hits.drop("role").join(tenants.select("tenant_id", "role", "allowed_tickers"), "tenant_id")
    return rbac_filter(known, permissions, allow="allowed_tickers").drop("allowed_tickers")


def context_tenant_filter(context: Column, role: Column, allowed: Column) -> Column:
    """Drop blank-line blocks whose ``[T Y]`` mark is not allowed; blocks without a mark stay.

    No list, or an empty one, yields an empty text.
    """
    upper = F.transform(allowed, F.upper)
    mark = r"\[([A-Z]{2,5})\s+\d{4}\]"

    def keep(block: Column) -> Column:
        ticker = F.regexp_extract(block, mark, 1)
        return (ticker == "") | F.array_contains(upper, ticker)

    filtered = F.array_join(F.filter(F.split(context, "\n\n"), keep), "\n\n")
    return F.when(role == "admin", context).when(F.size(allowed) > 0, filtered).otherwise(F.lit(""))
