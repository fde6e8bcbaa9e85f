"""Result writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", single: bool = False) -> None:
    """parquet, csv (with header) or json; ``single`` only for small summary tables."""
    writer = (df.coalesce(1) if single else df).write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    elif fmt in ("json", "parquet"):
        getattr(writer, fmt)(path)
    else:
        raise ValueError(f"unknown format '{fmt}'")


def write_results(results: dict, folder: str) -> None:
    """Tables as csv folders; plain values together as one json summary."""
    plain = {}
    spark = None
    for name, value in results.items():
        if isinstance(value, DataFrame):
            spark = value.sparkSession
            flat = [
                F.to_json(f.name).alias(f.name)
                if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
                for f in value.schema.fields
            ]
            write_table(value.select(*flat), f"{folder}/{name}", "csv")
        elif isinstance(value, (int, float, str)):
            plain[name] = value
    if plain and spark is not None:
        write_table(spark.createDataFrame([plain]), f"{folder}/summary", "json", single=True)


def write_counts(counts: DataFrame, labels: DataFrame, folder: str) -> None:
    """Sample x prototype counts in long form, with the sample labels beside them."""
    counts.write.mode("overwrite").parquet(f"{folder}/counts")
    labels.write.mode("overwrite").parquet(f"{folder}/labels")
