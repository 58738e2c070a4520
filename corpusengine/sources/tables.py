"""Structured questions on whitelisted tables, without forbidden fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tables that may be asked, and fields that never leave them.
ALLOWED = ("documents", "chat_sessions", "memory_long_term", "users")
FORBIDDEN = {"users": ("password_hash",)}


class Tables:
    """Named DataFrames; only allowed names resolve, and forbidden fields are gone whatever is asked."""

    def __init__(self, tables: dict[str, DataFrame], allowed=ALLOWED, forbidden: dict[str, tuple[str, ...]] | None = None):
        self.tables, self.allowed, self.forbidden = tables, allowed, FORBIDDEN if forbidden is None else forbidden

    def safe(self, name: str) -> DataFrame:
        if name not in self.allowed:
            raise ValueError(f"table {name} is not allowed")
        return self.tables[name].drop(*self.forbidden.get(name, ()))

    def scoped(self, name: str, tenant: str | None = None) -> DataFrame:
        """Own rows where the table has a tenant column."""
        df = self.tables[name] if name in self.allowed else self.safe(name)
        if tenant is not None and "tenant" in df.columns:
            df = df.filter(F.col("tenant") == tenant)
        return df

    def find(self, name: str, where: Column | None = None, columns: list[str] | None = None, order: list[Column] | None = None, limit: int = 10, tenant: str | None = None) -> DataFrame:
        df = self.scoped(name, tenant)
        df = df if where is None else df.filter(where)
        df = df.orderBy(*order) if order else df
        banned = self.forbidden.get(name, ())
        chosen = [c for c in (columns or df.columns) if c not in banned]
        return df.limit(limit).select(*chosen)

    def count(self, name: str, where: Column | None = None, tenant: str | None = None) -> DataFrame:
        df = self.scoped(name, tenant)
        return (df if where is None else df.filter(where)).agg(F.count("*").alias("n"))

    def latest(self, name: str, time: str = "created_at", tenant: str | None = None) -> DataFrame:
        return self.find(name, order=[F.desc(time)], limit=1, tenant=tenant)

    def aggregate(self, name: str, by: list[str], tenant: str | None = None, **aggregates: Column) -> DataFrame:
        df = self.scoped(name, tenant).drop(*self.forbidden.get(name, ()))
        return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])


def step_profile(events: DataFrame, step: str, ms: str) -> DataFrame:
    """Per step: n, mean, least, most, total and share of all time, longest total first.

    The steps are few, so the share's total is a window over the aggregate's rows.
    """
    from pyspark.sql import Window

    per = events.groupBy(F.col(step).alias("step")).agg(F.count("*").alias("n"), F.round(F.avg(ms), 6).alias("mean"), F.min(ms).alias("least"), F.max(ms).alias("most"), F.round(F.sum(ms), 4).alias("total"))
    return per.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1))), 6)).orderBy(F.desc("total"))
