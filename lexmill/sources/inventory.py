"""The inventory of abilities: checks, lookups of names and codes, pairs named in discriminators; job settings."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from lexmill.functions.text import technical_parts
from lexmill.operators.selecting import expect_none


def checked_inventory(abilities: DataFrame, seeds: DataFrame) -> DataFrame:
    """(uid, code, ability_name, broad_stratum, broad_name, n_seeds); fails on repeated uids, abilities without seeds, seeds of none."""
    expect_none(abilities.groupBy("uid").count().where("count > 1"), "abilities listed twice")
    n = seeds.groupBy(F.col("ability_code").alias("uid")).agg(F.count(F.lit(1)).alias("n_seeds"))
    expect_none(abilities.join(n, "uid", "left_anti").select("uid"), "abilities without seeds")
    expect_none(n.join(abilities, "uid", "left_anti").select("uid"), "seeds of unknown abilities")
    return abilities.join(n, "uid").select("uid", "code", "ability_name", "broad_stratum", "broad_name", "n_seeds")


def resolved_seeds(inventory: DataFrame, override: DataFrame | None) -> DataFrame:
    """Seeds, an ability's own replaced as a whole where the override has any for it."""
    if override is None:
        return inventory
    return inventory.join(override.select("ability_code").distinct(), "ability_code", "left_anti").unionByName(override)


def discriminator_pairs(abilities: DataFrame) -> DataFrame:
    """(a, b): unordered pairs of abilities where one's discriminator names the other: "vs CODE/CODE (Stratum); ...".

    A code is looked up in the named stratum, else in the ability's own, else among all if it is there once.
    """
    parts = abilities.select("uid", "broad_stratum", F.explode(F.split("discriminator", ";")).alias("_p"))
    named = parts.select("uid", "broad_stratum", F.regexp_extract("_p", r"vs\s+([A-Za-z0-9/]+)", 1).alias("_c"), F.regexp_extract("_p", r"vs\s+[A-Za-z0-9/]+\s+\((G[a-z]+)\)", 1).alias("_s")).where("_c <> ''")
    codes = named.select("uid", F.when(F.col("_s") != "", F.col("_s")).otherwise(F.col("broad_stratum")).alias("_s"), F.explode(F.split("_c", "/")).alias("_code"))
    known = abilities.select(F.col("uid").alias("_local"), F.col("code").alias("_code"), F.col("broad_stratum").alias("_s"))
    once = abilities.groupBy(F.col("code").alias("_code")).agg(F.min("uid").alias("_u"), F.count(F.lit(1)).alias("_n")).where("_n = 1").select("_code", "_u")
    met = codes.join(known, ["_code", "_s"], "left").join(once, "_code", "left").withColumn("_other", F.coalesce("_local", "_u"))
    return met.where("_other IS NOT NULL AND _other <> uid").select(F.least("uid", "_other").alias("a"), F.greatest("uid", "_other").alias("b")).distinct()


def aliases(abilities: DataFrame) -> DataFrame:
    """(alias, uid, n): each ability's name, parts of its name, and code; n abilities share the alias (1: it resolves)."""
    from pyspark.sql import Window

    names = abilities.select("uid", F.explode(F.array_union(technical_parts("ability_name"), F.array("code"))).alias("alias")).where("alias <> ''").distinct()
    return names.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("alias")))


@dataclass(frozen=True)
class Settings:
    """Settings of a job from a YAML file; a missing required key fails, given values override the file's."""

    values: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path, required: tuple[str, ...] = (), **given: object) -> Settings:
        import yaml

        values = {**(yaml.safe_load(Path(path).read_text()) or {}), **{k: v for k, v in given.items() if v is not None}}
        if missing := [k for k in required if values.get(k) is None]:
            raise KeyError(f"missing settings: {', '.join(missing)}")
        return cls(values)

    def __getitem__(self, key: str) -> object:
        return self.values[key]
