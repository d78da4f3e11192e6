"""Where results go: versioned state, tables, small reports and notes that keep what a user wrote."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ..operators import artifacts, state


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The history in the newest version below the path, or an empty one."""
    try:
        versions = spark.read.option("basePath", path).parquet(path)
        newest = versions.selectExpr("max(version) AS v").first()["v"]
    except AnalysisException:
        return state.empty_history(spark)
    return versions.where(f"version = {newest}").drop("version")


def write_state(history: DataFrame, path: str, version: int) -> None:
    """A new version beside the old ones, so that a failed write leaves those as they are."""
    history.write.mode("overwrite").parquet(f"{path}/version={version}")


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """A table of a report as json, csv or parquet files."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if form == "csv" else writer.json if form == "json" else writer.parquet)(path)


def read_artifacts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The artifacts in the newest version below the path (of those before a number), or none."""
    try:
        versions = spark.read.option("basePath", path).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], artifacts.SCHEMA)
    newest = versions.where("true" if before is None else f"version < {before}").selectExpr("max(version) AS v").first()["v"]
    return versions.where("false" if newest is None else f"version = {newest}").drop("version")


def merge_artifacts(found: DataFrame, path: str, batch: int) -> None:
    """Unites what a batch found with the version before it; a batch that comes again writes the same version again. For foreachBatch."""
    merged = artifacts.merged(read_artifacts(found.sparkSession, path, batch), found)
    merged.write.mode("overwrite").parquet(f"{path}/version={batch}")


#: Headings of a note that belong to the user.
KEPT = ("Notes", "Reflections")
FIELD = re.compile(r"^(\w+):: ?(.*)$", re.M)


def sections(note: str) -> dict[str, str]:
    """Text below each heading of the second level."""
    parts = re.split(r"(?m)^## (.+)$", note)
    return dict(zip([x.strip() for x in parts[1::2]], parts[2::2], strict=True))


def merge_note(generated: str, existing: str | None) -> str:
    """The generated note with the user's sections and answered fields (key:: value) of the existing one; sections of the user's own come last."""
    if not existing:
        return generated
    old, new = sections(existing), sections(generated)
    answers = {k: v for k, v in FIELD.findall(existing) if v.strip()}
    out = FIELD.sub(lambda m: f"{m[1]}:: {answers.get(m[1], m[2])}", generated)
    for name in KEPT:
        if name in new and old.get(name, "").strip():
            out = re.sub(rf"(?ms)^## {name}$.*?(?=^## |\Z)", lambda m, name=name: f"## {name}{old[name]}", out)
    extra = [f"## {k}{v}" for k, v in old.items() if k not in new]
    return out + "".join(("" if out.endswith("\n") else "\n", *extra)) if extra else out
