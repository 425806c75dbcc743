"""Catalogue of modules and plugins: documentation tables, install, uninstall and verify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioform.operators.validate import worst_loss


def plugins_by_kind(plugins: DataFrame, kind: str, plugin: str) -> DataFrame:
    """(kind, n_plugins, plugins): the distinct plugins of each kind, sorted; there are as many as plugins exist."""
    return plugins.groupBy(F.col(kind).alias("kind")).agg(F.count_distinct(plugin).alias("n_plugins"), F.array_join(F.sort_array(F.collect_set(plugin)), ", ").alias("plugins"))


def plugins_by_loss(plugins: DataFrame, plugin: str, loss: str) -> DataFrame:
    """(loss_class, n_plugins, plugins): every plugin under the worst loss class it has shown."""
    per = plugins.where(F.col(plugin).isNotNull()).groupBy(plugin).agg(worst_loss(F.col(loss)).alias("loss_class"))
    return plugins_by_kind(per, "loss_class", plugin).withColumnRenamed("kind", "loss_class")


def available(catalogue: DataFrame, installed: DataFrame, key: str = "module") -> DataFrame:
    """The catalogue with ``installed``: whether a module is there, and whether in the version offered."""
    i = installed.select(key, F.col("version").alias("_have"))
    j = catalogue.join(i, key, "left")
    return j.select(*catalogue.columns, F.when(F.col("_have").isNull(), "no").when(F.col("_have").eqNullSafe(F.col("version")), "yes").otherwise("other version").alias("installed"))


def install(catalogue: DataFrame, installed: DataFrame, wanted: list[str], key: str = "module") -> DataFrame:
    """The installed modules once ``wanted`` ones of the catalogue are added or brought to its version; unknown names change nothing."""
    new = catalogue.where(F.col(key).isin(wanted)).select(*installed.columns)
    return installed.join(new.select(key), key, "left_anti").select(*installed.columns).unionByName(new)


def uninstall(installed: DataFrame, names: list[str], key: str = "module") -> DataFrame:
    return installed.where(~F.col(key).isin(names))


def verify(installed: DataFrame, files: DataFrame, key: str = "module") -> DataFrame:
    """(module, n_files, n_bytes, status) against the ``files`` (module, length) found: ok, empty (files without bytes) or missing."""
    have = files.groupBy(key).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
    j = installed.select(key).distinct().join(have, key, "left")
    status = F.when(F.col("n_files").isNull(), "missing").when(F.col("n_bytes") > 0, "ok").otherwise("empty")
    return j.select(key, F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), status.alias("status"))
