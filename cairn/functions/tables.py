"""Fixed tables that come with the package, and the caller's own in their stead."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DATA = Path(__file__).resolve().parent.parent / "data"
SCHEMAS = {"weights": "base_type string, sub_type string, weight double", "spell_levels": "spell string, spell_level int"}


def rows_of(name: str) -> list[list[str]]:
    """The package's own rows, under 200 in each table."""
    with open(DATA / f"{name}.csv", encoding="utf-8", newline="") as file:
        return list(csv.reader(line for line in file if not line.startswith("#")))[1:]


def fixed_table(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """weights or spell_levels: from a CSV file with a header (lines from # on are remarks) at a path that Spark reads, or the package's."""
    if path is not None:
        return spark.read.csv(path, schema=SCHEMAS[name], header=True, comment="#")
    kinds = [c.split()[1] for c in SCHEMAS[name].split(", ")]
    read = {"string": str, "double": float, "int": int}
    return spark.createDataFrame([tuple(read[k](v) for k, v in zip(kinds, row)) for row in rows_of(name)], SCHEMAS[name])
