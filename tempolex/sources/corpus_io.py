"""Versions in files: JSON arrays and JSON Lines (plain or gzip), with an optional header row, and validation before use."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = """statute string, unit string, number string, heading string, text string, in_force_from string, in_force_to string, superseded_by string, manner string,
amended_by string, language string, chapter string, enacted_by string, start_known boolean, end_known boolean, note string, source string"""
REQUIRED = ["statute", "unit", "number", "heading", "text", "in_force_from"]
UNITS = ["section", "article", "rule"]


#: Where a corpus may be named if the caller names none.
CORPUS_ENV, CORPUS_FILE = "TEMPOLEX_CORPUS", "corpus.jsonl.gz"


class BadRows(ValueError):
    """Rows that cannot be read or break a rule of the table."""


def read_rows(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Rows of a file or folder, with _bad holding the text of a line that is no row. gzip goes by the file's ending.

    A header row {"_corpus": {...}} is left out; array reads one JSON array per file.
    """
    reader = spark.read.schema(f"{ROW}, _corpus string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", array)
    rows = reader.json(path)
    return rows.where(F.col("_corpus").isNull()).drop("_corpus")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(as_at, meta): the header row of a file, if it has one."""
    lines = spark.read.text(path).where(F.get_json_object("value", "$._corpus").isNotNull())
    return lines.select(F.get_json_object("value", "$._corpus.as_at").alias("as_at"), F.get_json_object("value", "$._corpus").alias("meta"))


def unknown_fields(spark: SparkSession, path: str) -> list[str]:
    """Fields of the rows that the table does not have; the driver sees names only."""
    keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("k")).distinct()
    known = {f.split()[0] for f in ROW.replace("\n", " ").split(", ")} | {"_corpus"}
    return sorted(r.k for r in keys.where(~F.col("k").isin(sorted(known))).limit(100).collect())


def row_problems(rows: DataFrame) -> DataFrame:
    """(statute, unit, number, problem) of rows that break a rule: a missing field, a unit or date that is none, an end not after its start."""
    start, end = F.try_to_date("in_force_from", "yyyy-MM-dd"), F.try_to_date("in_force_to", "yyyy-MM-dd")
    found = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in REQUIRED]
    found += [
        F.when(~F.lower(F.trim("unit")).isin(UNITS), "unknown unit"),
        F.when(F.col("in_force_from").isNotNull() & start.isNull(), "bad start"),
        F.when(F.col("in_force_to").isNotNull() & end.isNull(), "bad end"),
        F.when(end <= start, "end not after start"),
        F.when(~F.coalesce("end_known", F.lit(True)) & F.col("in_force_to").isNull(), "unknown end without an end"),
    ]
    if "_bad" in rows.columns:
        found.append(F.when(F.col("_bad").isNotNull(), F.concat(F.lit("unreadable: "), F.substring("_bad", 1, 200))))
    listed = F.filter(F.array(*found), lambda p: p.isNotNull())
    return rows.select("statute", "unit", "number", F.explode(listed).alias("problem"))


def checked_rows(rows: DataFrame) -> DataFrame:
    """The rows with dates, or BadRows with the first problems if any row has one."""
    bad = row_problems(rows).limit(20).collect()
    if bad:
        raise BadRows("; ".join(f"{r.statute}:{r.unit}:{r.number}: {r.problem}" for r in bad))
    return rows.drop("_bad").withColumns({c: F.to_date(c, "yyyy-MM-dd") for c in ("in_force_from", "in_force_to")})


def resolve_corpus(path: str | None = None, default: str = CORPUS_FILE) -> str:
    """The named corpus, else the one of the environment, else the default."""
    return path or os.environ.get(CORPUS_ENV) or default


def load_corpus(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, str]:
    """(rows with dates, as_at) of a corpus in JSON Lines, or BadRows: unreadable rows, unknown fields, a header elsewhere than first, or no rows at all."""
    path = resolve_corpus(path)
    unknown = unknown_fields(spark, path)
    if unknown:
        raise BadRows("unknown fields: " + ", ".join(unknown))
    late = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    headers = late.groupBy("f").agg(F.min("n").alias("first"), F.max(F.when(F.get_json_object("value", "$._corpus").isNotNull(), F.col("n"))).alias("head"), F.count_if(F.get_json_object("value", "$._corpus").isNotNull()).alias("heads"))
    if headers.where("heads > 1 or head <> first").limit(1).count():
        raise BadRows("a header that is not the first row")
    rows = checked_rows(read_rows(spark, path))
    if rows.limit(1).count() == 0:
        raise BadRows("no rows")
    meta = read_meta(spark, path).first()
    return rows, (meta.as_at or "") if meta else ""


def merged(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables, refusing any key they share."""
    key = ["statute", "unit", "number"]
    shared = new.select(*key).join(existing.select(*key), key, "left_semi").limit(5).collect()
    if shared:
        raise BadRows("already held: " + ", ".join(":".join(r) for r in shared))
    return existing.unionByName(new, allowMissingColumns=True)


def write_jsonl(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """JSON Lines in the order statute, unit, provision, start; the committer makes the replacement whole or not at all."""
    from tempolex.operators.temporal import provision_order

    order = provision_order(F.col("number"))
    names = ["order_scheme", "order_n", "order_suffix", "order_rule"]
    rows.select("*", *order).orderBy("statute", "unit", *names, "in_force_from").drop(*names).write.mode("overwrite").option("compression", compression).json(path)
