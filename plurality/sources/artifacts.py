"""Finding the files of a stage's output: listings on the driver, checks of their records.

Only names are listed, so work here grows with the number of files, never with their rows.
"""

from __future__ import annotations

import fnmatch
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.sources import readers

# Files of a question folder that hold no question.
NO_QUESTION = ("metadata", "manifest", "summary", "stats")


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> list[str]:
    """Sorted paths of files below ``root`` whose path ends in the pattern; a file is itself."""
    place, fs = _place(spark, root)
    if not fs.exists(place):
        raise FileNotFoundError(root)
    found, files = [], fs.listFiles(place, recursive)
    while files.hasNext():
        path = files.next().getPath().toString()
        if fnmatch.fnmatch(path, f"*/{pattern}"):
            found.append(path)
    return sorted(found)


def is_file(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place) and fs.getFileStatus(place).isFile()


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(path).first().value)


def raw_question_files(spark: SparkSession, root: str) -> list[str]:
    """Files of ``questions/`` folders if there are any, else all that can hold a question."""
    nested = listed(spark, root, "questions/*.json")
    if nested:
        return nested
    return [p for p in listed(spark, root, "*.json") if not any(t in p.rsplit("/", 1)[-1].lower() for t in NO_QUESTION)]


def question_table(spark: SparkSession, root: str, schema: str, key: str = "question_id", needed: tuple[str, ...] = ("question_id", "samples")) -> DataFrame:
    """Questions of every JSON file below ``root``; metadata, unreadable and other files are
    skipped. An id in two files is an error, and so is no question at all."""
    files = [p for p in listed(spark, root, "*.json") if not p.endswith(("metadata.json", "manifest.json", "stats.json"))]
    if not files:
        raise FileNotFoundError(f"no questions below {root}")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(files).withColumn("source_file", F.col("_metadata.file_path"))
    for column in needed:
        rows = rows.where(F.col(column).isNotNull())
    twice = readers.duplicate_questions(rows, key).limit(1).collect()
    if twice:
        raise ValueError(f"question {twice[0].id!r} stands in {twice[0].rows} files")
    if not rows.limit(1).count():
        raise FileNotFoundError(f"no questions below {root}")
    return rows


def split_table(spark: SparkSession, root: str, dataset: str, split: str, schema: str) -> DataFrame:
    """``<root>/<dataset>/<split>.jsonl``, or a folder of that name; missing is an error."""
    for path in (f"{root.rstrip('/')}/{dataset}/{split}.jsonl", f"{root.rstrip('/')}/{dataset}/{split}"):
        if exists(spark, path):
            return readers.json_lines(spark, path, schema)
    raise FileNotFoundError(f"no {split} split of {dataset} below {root}")


def response_sources(spark: SparkSession, path: str) -> list[str]:
    """Files of responses below a path, none of them twice: its own chunks; else those of the
    shards whose metadata lie below (a shard's chunks, or its merged file); else merged files."""
    if is_file(spark, path):
        return [path]
    root = path.rstrip("/")
    if exists(spark, f"{root}/chunks"):
        direct = listed(spark, f"{root}/chunks", "chunk-*.jsonl", recursive=False)
        if direct:
            return direct
    found: list[str] = []
    for metadata in listed(spark, root, "response_metadata.json"):
        folder = metadata.rsplit("/", 1)[0]
        chunks = listed(spark, f"{folder}/chunks", "chunk-*.jsonl", recursive=False) if exists(spark, f"{folder}/chunks") else []
        if chunks:
            found += chunks
        elif exists(spark, f"{folder}/responses.jsonl"):
            found.append(f"{folder}/responses.jsonl")
    found = found or listed(spark, root, "responses.jsonl")
    if not found:
        raise FileNotFoundError(f"no responses below {path}")
    return found


def confidence_sources(spark: SparkSession, inputs: list[str]) -> list[str]:
    """Merged confidence files of the inputs, each once. Chunks without a merged file mean
    that the stage did not end, which is an error."""
    found: list[str] = []
    for path in inputs:
        if is_file(spark, path):
            found.append(path)
            continue
        root = path.rstrip("/")
        direct = f"{root}/confidence.jsonl"
        if exists(spark, direct):
            found.append(direct)
            continue
        merged = listed(spark, root, "confidence.jsonl")
        if not merged and listed(spark, root, "chunks/chunk-*.jsonl"):
            raise ValueError(f"chunks but no merged file below {path}: a partial report is refused")
        if not merged:
            raise FileNotFoundError(f"no confidence files below {path}")
        found += merged
    if not found:
        raise ValueError("no inputs")
    return list(dict.fromkeys(found))


def manifest_violations(spark: SparkSession, manifests: DataFrame, rows: DataFrame) -> DataFrame:
    """``source, rule`` for shards whose records do not say what their rows are.

    ``manifests``: ``source, complete, samples, expected_samples, questions, group, shard,
    shards`` (null where not stated). ``rows``: ``source, sample_id, question_id``. Checked:
    completeness, counts, blank and repeated ids, shard numbers, and that a group has all of
    its shards.
    """
    ids = rows.groupBy("source", "sample_id").agg(F.count("*").alias("n"), F.count_if(F.col("question_id").isNull() | (F.col("question_id") == "")).alias("blank"))
    blank = F.col("sample_id").isNull() | (F.col("sample_id") == "")
    per = ids.groupBy("source").agg(F.sum("n").alias("found"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(blank).alias("no_id"), F.sum("blank").alias("no_question"))
    asked = rows.groupBy("source").agg(F.count_distinct("question_id").alias("found_questions"))
    m = manifests.join(per, "source", "left").join(asked, "source", "left")
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    found, number = F.coalesce("found", F.lit(0)), F.coalesce("shards", F.lit(1))
    checks = [
        ("incomplete", ~F.coalesce("complete", F.lit(False))), ("expected_samples", differs("samples", "expected_samples")), ("samples", F.coalesce(F.col("samples") != found, F.lit(False))), ("questions", F.coalesce(F.col("questions") != F.coalesce("found_questions", F.lit(0)), F.lit(False))),
        ("repeated_sample", F.coalesce("repeated", F.lit(0)) > 0), ("blank_sample", F.coalesce("no_id", F.lit(0)) > 0), ("blank_question", F.coalesce("no_question", F.lit(0)) > 0), ("shard_number", (number <= 0) | ~F.coalesce("shard", F.lit(0)).between(0, number - 1)),
    ]
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in checks]))
    own = m.select("source", F.explode(broken).alias("rule"))
    groups = manifests.where("shards > 1").groupBy("group").agg(F.count_distinct("shard").alias("have"), F.min("shards").alias("low"), F.max("shards").alias("high"))
    partial = groups.where("have <> high OR low <> high").select(F.col("group").alias("source"), F.when(F.col("low") != F.col("high"), "other_shards").otherwise("missing_shards").alias("rule"))
    return own.unionByName(partial)


def legacy_rows(spark: SparkSession, paths: str | list[str], aliases: dict[str, list[str]], item: str) -> DataFrame:
    """Report rows of older files: each logical column is the first alias that is not null."""
    rows = readers.polymorphic(spark, paths, item)
    return rows.select("source_file", *[F.coalesce(*[F.col(a) for a in names if a in rows.columns]).alias(name) for name, names in aliases.items()])


def may_resume(spark: SparkSession, path: str, settings: dict) -> bool:
    """Whether a finished output with the same settings stands at ``path``; other settings
    there are an error, as its rows would be mixed with new ones."""
    if not exists(spark, f"{path.rstrip('/')}/settings.json"):
        return False
    before = record(spark, f"{path.rstrip('/')}/settings.json")
    if before != settings:
        raise ValueError(f"output at {path} has other settings: {sorted(k for k in before.keys() | settings.keys() if before.get(k) != settings.get(k))}")
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def grouped_payloads(rows: DataFrame, dataset: str = "dataset_name", key: str = "question_id", source: str = "source_index", text: str = "original_question", samples: str = "samples") -> DataFrame:
    """Questions from several files as one: by data set and id, or where the id is blank by a
    hash of data set, source and text; samples are put together, and files listed."""
    from plurality.functions.hashing import stable_id

    fallback = stable_id(F.col(dataset), F.col(source), F.coalesce(F.col(text), F.lit("")), length=20)
    keyed = rows.withColumn("group_key", F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), fallback))
    return keyed.groupBy(dataset, "group_key").agg(
        F.min(key).alias(key), F.min(source).alias(source), F.min(text).alias(text), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_file", samples))), lambda x: x[samples])).alias(samples), F.array_sort(F.collect_set("source_file")).alias("source_files"),
    )
