"""Registers and crosswalks of persons and firms, and what other lists say about them by printed name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register(mentions: DataFrame, entity: str) -> DataFrame:
    """entity, n_mentions, years_present, n_waves: one row for each, years joined by semicolons."""
    # mentions are counted by entity and year first, so an entity's years are a short list
    by_year = mentions.groupBy(entity, "year").agg(F.count("*").alias("n"))
    years = F.array_join(F.transform(F.sort_array(F.collect_list("year")), lambda y: y.cast("string")), ";")
    return by_year.groupBy(entity).agg(F.sum("n").alias("n_mentions"), years.alias("years_present"), F.count("*").alias("n_waves"))


def last_known(mentions: DataFrame, entity: str, *attributes: str) -> DataFrame:
    """entity with its attributes of the last year; of several rows of that year the greatest counts."""
    last = F.max(F.struct("year", *attributes)).alias("r")
    return mentions.groupBy(entity).agg(last).select(entity, *[F.col(f"r.{a}").alias(a) for a in ("year", *attributes)])


def crosswalk(mentions: DataFrame, entity: str, printed: str) -> DataFrame:
    """year, printed, entity: the smallest entity of each name of a year, once."""
    return mentions.groupBy("year", printed).agg(F.min(entity).alias(entity))


def named(listed: DataFrame, names: DataFrame, printed: str) -> DataFrame:
    """Rows listed by year and printed name, with the entity of that name; unknown names and repeats go."""
    return listed.join(names, ["year", printed]).drop(printed).distinct()
