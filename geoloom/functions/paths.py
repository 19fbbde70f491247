"""Paths of proposed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a contribution may change, the form of its file names, and how many files at most.
ALLOWED_PREFIX = "data/overlay/"
ALLOWED_FILES = ("data/coverage.json", "data/refutations.jsonl", "data/ncei-match-report.json", "data/ncei-candidates.json")
OVERLAY_FILE = r"^whs_[0-9a-f]{12}\.json$"
MOST_FILES = 260


def clean_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, with ``..`` taking one part away; backslashes part too."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    shorter = lambda stack: F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
    step = lambda stack, part: F.when(part.isin("", "."), stack).when(part == "..", shorter(stack)).otherwise(F.array_append(stack, part))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def path_fault(path: Column) -> Column:
    """Why a contribution may not change a path, or null."""
    clean = clean_path(path)
    name = F.substring(clean, len(ALLOWED_PREFIX) + 1, 10**6)
    return (
        F.when(clean.isin(*ALLOWED_FILES), None).when(~clean.startswith(ALLOWED_PREFIX), F.concat(path, F.lit(f": a contribution may only modify {ALLOWED_PREFIX}**")))
        .when(F.contains(name, F.lit("/")), F.concat(path, F.lit(f": {ALLOWED_PREFIX} has no subdirectories")))
        .when(~name.rlike(OVERLAY_FILE), F.concat(path, F.lit(": overlay files are named <spring-id>.json, e.g. whs_a1b2c3d4e5f6.json")))
    )


def path_faults(files: DataFrame) -> DataFrame:
    """(change, error): what is wrong with each changeset's paths (change, path); too many files are that one error only."""
    sizes = files.groupBy("change").agg(F.count("*").alias("_n"))
    many = F.concat(F.lit("too many files: "), F.col("_n").cast("string"), F.lit(f" changed, limit is {MOST_FILES}. Split this into smaller submissions."))
    crowded = sizes.where(F.col("_n") > MOST_FILES)
    single = files.join(crowded, "change", "left_anti").select("change", path_fault(F.col("path")).alias("error")).where("error is not null")
    return single.unionByName(crowded.select("change", many.alias("error")))
