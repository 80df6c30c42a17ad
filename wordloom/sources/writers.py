"""Writers of spaces, tables and models."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.models import ModelStore


def write_space(space: DataFrame, path: str, digits: int = 25) -> None:
    """Tab-separated cells without header."""
    space.select(F.concat_ws("\t", "target", "context", F.format_string(f"%.{digits}f", "value"))).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_dense(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Lines word<tab>v v v."""
    line = F.concat_ws("\t", "word", F.array_join(F.col("vector").cast("array<string>"), " "))
    rows.select(line).write.mode("overwrite").option("compression", compression).text(path)


def save_model(tables: dict[str, DataFrame], path: str, iteration: int) -> None:
    """Publish a model's tables as one version (see ``models.ModelStore``); undefined numbers are refused."""
    ModelStore(next(iter(tables.values())).sparkSession, path).publish(tables, iteration)


def load_model(spark: SparkSession, path: str, names: list[str], iteration: int | None = None) -> dict[str, DataFrame]:
    """A model's tables of one iteration, the last published by default."""
    found = ModelStore(spark, path).load(iteration)
    if found is None:
        raise FileNotFoundError(f"no model in {path}")
    return {name: found[0][name] for name in names}


def write_factors(left: DataFrame, sigmas: DataFrame, right: DataFrame, path: str) -> None:
    """The tables of a singular value decomposition, each in its own folder."""
    for name, df in (("left", left), ("sigmas", sigmas), ("right", right)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def cached_corpus(corpus: DataFrame, path: str) -> DataFrame:
    """The parsed corpus written once as Parquet and read from there; one of other source files, or without files of another plan, has another folder of ``path``."""
    source = sorted(corpus.inputFiles()) or [str(corpus.semanticHash())]
    key = hashlib.sha256("\n".join([corpus.schema.simpleString(), *source]).encode()).hexdigest()[:16]
    corpus.write.mode("ignore").parquet(f"{path}/{key}")
    return corpus.sparkSession.read.schema(corpus.schema).parquet(f"{path}/{key}")
