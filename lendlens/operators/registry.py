"""Models kept as a table: list, pick and filter by domain, name, version and role."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def register(models: DataFrame, domain: str, version: str, champion: str) -> DataFrame:
    """Labels coefficient rows with domain, version and role."""
    role = F.when(F.col("model_name") == champion, "champion").otherwise("challenger")
    return models.select(
        F.lit(domain).alias("domain"), "model_name", F.lit(version).alias("version"),
        role.alias("role"), "feature", "coefficient")


def pick_models(registry: DataFrame, domain: str | None = None, name: str | None = None,
                version: str | None = None, role: str | None = None) -> DataFrame:
    wanted = {"domain": domain, "model_name": name, "version": version, "role": role}
    for column, value in wanted.items():
        if value is not None:
            registry = registry.where(F.col(column) == value)
    return registry


def list_models(registry: DataFrame, domain: str | None = None) -> DataFrame:
    """One row per model with its number of features."""
    return pick_models(registry, domain).groupBy("domain", "model_name", "version", "role").agg(
        F.count(F.lit(1)).alias("coefficients"))


def list_domains(registry: DataFrame) -> DataFrame:
    return registry.select("domain").distinct()
