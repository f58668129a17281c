"""Scans of question, response and report files, with the checks their users rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Aliases of logical columns, the first one present in a row winning.
ALIASES = {
    "canonical_answer": ["canonicalized_answer", "canonical_answer"],
    "extracted_answer": ["extracted_answer", "answer"],
    "valid": ["is_valid_answer", "valid"],
    "relation_weight": ["relation_weight", "relation_reliability", "r_g", "r"],
    "dependency_weight": ["dependency_weight", "d_gi", "d"],
    "cluster": ["dependency_cluster_id", "strategy_cluster_id"],
    "strategy_text": ["response", "reasoning", "text"],
    "fragility": ["fragility", "predicted_fragility"],
    "relssc": ["relssc", "relational_consistency", "weighted_consistency"],
    "prompt": ["transformed_prompt", "original_prompt", "transformed_question"],
    "gold": ["correct_answer", "gold_original_answer", "gold_answer"],
}
DEFAULTS = {"valid": True, "relation_weight": 1.0, "dependency_weight": 1.0}


def json_lines(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """One object a line, blank lines skipped; with ``strict`` a bad line fails the scan,
    else it is dropped. ``source_file`` tells where a row is from."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(paths).withColumn("source_file", F.col("_metadata.file_path"))


def json_files(spark: SparkSession, paths: str | list[str], schema: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """One object (or a list of them) a file."""
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.json(paths).withColumn("source_file", F.col("_metadata.file_path"))


def question_files(spark: SparkSession, root: str, schema: str, datasets: list[str] | None = None) -> DataFrame:
    """``<root>/<dataset>/questions/*.json`` with a ``dataset`` column from the path.

    A wanted data set without a question is an error.
    """
    names = "*" if datasets is None else "{" + ",".join(sorted(datasets)) + "}"
    rows = json_files(spark, f"{root.rstrip('/')}/{names}/questions/*.json", schema)
    rows = rows.withColumn("dataset", F.regexp_extract("source_file", r"([^/]+)/questions/[^/]+$", 1))
    if datasets is not None:
        found = {r.dataset for r in rows.select("dataset").distinct().collect()}
        if lost := sorted(set(datasets) - found):
            raise FileNotFoundError(f"no questions for {lost}")
    return rows


def polymorphic(spark: SparkSession, paths: str | list[str], item: str) -> DataFrame:
    """Objects from files that hold one object, a list, or ``{"results": [...]}``.

    ``item`` is the struct of an object; ``position`` counts within a file. A file that is no
    such JSON fails the scan; an empty one holds nothing.
    """
    rows = spark.read.option("wholetext", True).text(paths).select("value", F.col("_metadata.file_path").alias("source_file"))
    text = F.trim("value")
    strict = {"mode": "FAILFAST"}
    kind = F.when(text.startswith("["), "list").when(F.json_object_keys(text).isNull(), "bad").when(F.array_contains(F.json_object_keys(text), "results"), "results").otherwise("one")
    bad = F.raise_error(F.concat(F.lit("malformed JSON in "), F.col("source_file"))).cast(f"array<struct<{item}>>")
    listed = (
        F.when(kind == "list", F.from_json(F.when(kind == "list", text), f"array<struct<{item}>>", strict))
        .when(kind == "results", F.from_json(F.when(kind == "results", text), f"results array<struct<{item}>>", strict)["results"])
        .when(kind == "one", F.array(F.from_json(F.when(kind == "one", text), f"struct<{item}>", strict)))
        .otherwise(bad)
    )
    return rows.select("source_file", F.posexplode(listed).alias("position", "item")).select("source_file", "position", "item.*")


def samples(questions: DataFrame, column: str = "samples", strict: bool = True) -> DataFrame:
    """One row for each sample of nested questions, ``row_index`` being its place.

    A question without samples is an error, or with ``strict=False`` one row whose
    ``row_index`` and sample are null, so that it stays in every denominator.
    """
    rest = [c for c in questions.columns if c != column]
    if strict:
        some = F.when(F.size(column) > 0, F.col(column)).otherwise(F.raise_error(F.lit("a question has no samples")).cast(dict(questions.dtypes)[column]))
        return questions.select(*rest, F.posexplode(some).alias("row_index", "_s")).select(*rest, "row_index", "_s.*")
    return questions.select(*rest, F.posexplode_outer(column).alias("row_index", "_s")).select(*rest, "row_index", "_s.*")


def logical(rows: DataFrame, name: str, first_present: bool = True) -> Column:
    """A logical column by its aliases.

    ``first_present`` takes the first alias the table has, even where it is null; else the
    first value that is not null.
    """
    there = [F.col(c) for c in ALIASES[name] if c in rows.columns]
    default = F.lit(DEFAULTS.get(name))
    if not there:
        return default
    return there[0] if first_present else F.coalesce(*there, default)


def duplicate_questions(questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Blank ids, and ids of more than one question."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    return questions.groupBy(F.col(key).alias("id"), blank.alias("blank")).agg(F.count("*").alias("rows")).where("blank OR rows > 1")


def shard(rows: DataFrame, index: str, shards: int, number: int) -> DataFrame:
    """Rows whose explicit index leaves ``number`` by ``shards``."""
    if not 0 <= number < shards:
        raise ValueError("the shard must be from 0 to shards - 1")
    return rows.where(F.pmod(F.col(index), F.lit(shards)) == number)


def batch_of(index: str, size: int) -> Column:
    return F.floor(F.col(index) / size)


def conversion_failures(rows: DataFrame, checks: dict[str, Column], limit: int = 3) -> list[str]:
    """The first messages of rows that break a check, for one error over all of them."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in checks.items()]))
    return [r.m for r in rows.select(F.explode(broken).alias("m")).groupBy("m").count().orderBy(F.desc("count"), "m").limit(limit).collect()]
