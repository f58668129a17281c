"""Report and record sinks: committed as a whole, fixed columns, small Markdown tables."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.functions.hashing import ordered_digest
from plurality.operators import records


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replaced_whole(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Runs ``write`` on a staging folder beside ``path``, then puts it in the old one's place.

    If the job fails, what stood there before still does. On stores that rename by copying,
    the last step is not a single one.
    """
    staged, before = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}", f"{path.rstrip('/')}.before-{uuid.uuid4().hex}"
    (target, fs), (new, _), (old, _) = _place(spark, path.rstrip("/")), _place(spark, staged), _place(spark, before)
    try:
        write(staged)
        there = fs.exists(target)
        if there and not fs.rename(target, old):
            raise OSError(f"{path} can not be moved")
        if not fs.rename(new, target):
            if there:
                fs.rename(old, target)
            raise OSError(f"{staged} can not be moved to {path}")
        if there:
            fs.delete(old, True)
    finally:
        fs.delete(new, True)


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line; the old table stays until the new one is whole."""
    replaced_whole(rows.sparkSession, path, lambda p: rows.write.option("ignoreNullFields", False).json(p))


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None, digits: int | None = None) -> None:
    """CSV with a header: the named columns (missing ones empty, others left out), finite
    doubles rounded to ``digits`` if given."""
    columns = columns or rows.columns
    kinds = dict(rows.dtypes)

    def one(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string").alias(name)
        value = F.col(name)
        if digits is not None and kinds[name] in ("double", "float"):
            value = F.round(value, digits)
        return value.alias(name)

    shown = rows.select(*map(one, columns))
    replaced_whole(rows.sparkSession, path, lambda p: shown.write.option("header", True).csv(p))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows with all columns, in order of first sight."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def check_metadata(spark: SparkSession, path: str, metadata: dict) -> bool:
    """Writes a small record once; later it must be equal. True if it was written now."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        before = json.loads(spark.read.option("wholetext", True).text(path).first().value)
        if before != metadata:
            keys = sorted(k for k in before.keys() | metadata.keys() if before.get(k) != metadata.get(k))
            raise ValueError(f"metadata at {path} differs in {keys}")
        return False
    replaced_whole(spark, path, lambda p: _put_text(spark, p, json.dumps(metadata, sort_keys=True)))
    return True


def chunk_summary(rows: DataFrame, chunk: str, question: str, order: str) -> DataFrame:
    """Per chunk: questions, samples, and the digest of its ordered question ids.

    A chunk is a batch of fixed size, so its ids fit one array.
    """
    ids = rows.groupBy(chunk, question).agg(F.min(order).alias("_o"), F.count("*").alias("_n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_o", question))), lambda x: x[question])
    return ids.groupBy(chunk).agg(F.count("*").alias("questions"), F.sum("_n").alias("samples"), ordered_digest(listed).alias("digest"))


def incomplete_chunks(rows: DataFrame, chunk: str, question: str, order: str, expected: DataFrame, required: list[str]) -> DataFrame:
    """Chunks whose ordered ids differ from the expected ones, or with a null in a
    required field. ``expected`` has ``chunk, digest``."""
    gaps = F.lit(False)
    for c in required:
        gaps = gaps | F.col(c).isNull()
    holes = rows.groupBy(chunk).agg(F.count_if(gaps).alias("nulls"))
    found = chunk_summary(rows, chunk, question, order).join(holes, chunk)
    joined = expected.select(chunk, F.col("digest").alias("wanted")).join(found, chunk, "full")
    return joined.where(~F.coalesce(F.col("digest") == F.col("wanted"), F.lit(False)) | (F.coalesce("nulls", F.lit(0)) > 0)).select(chunk, "nulls")


def source_signature(rows: DataFrame) -> DataFrame:
    """Path, size and modification time of the files read."""
    return rows.select(*[F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]).distinct()


def number(value: float | None, digits: int = 4, percent: bool = False) -> str:
    if value is None or not math.isfinite(value):
        return "-"
    return f"{100 * value:.{digits}f}%" if percent else f"{value:.{digits}f}"


def markdown(rows: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A Markdown table of a small report; more than ``most`` rows are an error."""
    data = rows.select(*columns).limit(most + 1).collect()
    if len(data) > most:
        raise ValueError(f"a report has at most {most} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line([number(v) if isinstance(v, float) else "-" if v is None else str(v) for v in r]) for r in data]
    return "\n".join([line(columns), line(["---"] * len(columns)), *body]) + "\n"


def write_report(report: DataFrame, columns: list[str], path: str, title: str, most: int = 10_000) -> None:
    """A report in three forms below ``path``: ``rows.json``, ``rows.csv`` with exactly
    ``columns``, and the Markdown table ``report.md``, all put in place at once."""
    spark = report.sparkSession

    def write(staged: str) -> None:
        report.coalesce(1).write.option("ignoreNullFields", False).json(f"{staged}/rows.json")
        absent = [F.lit(None).cast("string").alias(c) if c not in report.columns else F.col(c) for c in columns]
        report.select(*absent).coalesce(1).write.option("header", True).csv(f"{staged}/rows.csv")
        text = f"# {title}\n\n{markdown(report, [c for c in columns if c in report.columns], most)}"
        write_text(spark, f"{staged}/report.md", text)

    replaced_whole(spark, path, write)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small record, staged and then renamed, so that no reader sees half of it."""
    replaced_whole(spark, path, lambda p: _put_text(spark, p, text))


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    place, fs = _place(spark, path)
    stream = fs.create(place, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def write_manifest(spark: SparkSession, path: str, kind: str, stats: dict) -> None:
    """A small record beside a table: what it is, and its counts and digest."""
    write_text(spark, path, json.dumps({"schema_version": 1, "artifact_type": kind, **stats}, sort_keys=True))


def write_comparison(left: DataFrame, right: DataFrame, budget: int, keys: list[str], path: str, title: str) -> None:
    """Two reports' methods side by side (``records.paired_reports``) in the three forms."""
    rows = records.paired_reports(left, right, budget, keys).orderBy(*keys)
    write_report(rows, rows.columns, path, title)


def _chunk_digests(rows: DataFrame, chunk: str, key: str) -> DataFrame:
    """``chunk, rows, digest`` of a chunk's rows in the order of ``key``; a chunk has a fixed
    size, so its rows' digests fit one array."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), row.alias("d")))), lambda x: x["d"])
    return rows.groupBy(chunk).agg(F.count("*").alias("rows"), ordered_digest(listed).alias("digest"))


def publish(rows: DataFrame, root: str, chunk: str, key: str) -> dict:
    """A new version of a table of chunks below ``root``; the pointer to it is swapped last.

    ``versions/<id>/rows`` holds the rows by chunk, ``versions/<id>/chunks`` a digest of each
    chunk's rows; ``current.json`` names the version and the digest over all chunks. Until
    it is replaced readers see the version before; a run that stops earlier leaves only a
    folder that nothing names. Returns the record.
    """
    spark = rows.sparkSession
    version = uuid.uuid4().hex
    at = f"{root.rstrip('/')}/versions/{version}"
    rows.write.partitionBy(chunk).parquet(f"{at}/rows")
    _chunk_digests(rows, chunk, key).write.parquet(f"{at}/chunks")
    per = spark.read.parquet(f"{at}/chunks")
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(chunk, "digest"))), lambda x: x["digest"]), ","), 256)
    total = per.agg(F.sum("rows").alias("rows"), F.count("*").alias("chunks"), whole.alias("digest")).first()
    record = {"version": version, "rows": total.rows or 0, "chunks": total.chunks, "digest": total.digest}
    write_text(spark, f"{root.rstrip('/')}/current.json", json.dumps(record, sort_keys=True))
    return record


def published(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    """(rows, digests of chunks) of the version that ``root`` names; None before the first."""
    place, fs = _place(spark, f"{root.rstrip('/')}/current.json")
    if not fs.exists(place):
        return None
    record = json.loads(spark.read.option("wholetext", True).text(f"{root.rstrip('/')}/current.json").first().value)
    at = f"{root.rstrip('/')}/versions/{record['version']}"
    return spark.read.parquet(f"{at}/rows"), spark.read.parquet(f"{at}/chunks")


def changed_chunks(before: DataFrame | None, rows: DataFrame, chunk: str, key: str) -> DataFrame:
    """Chunks of ``rows`` that differ from published digests ``before`` or are not there."""
    now = _chunk_digests(rows, chunk, key)
    return now.select(chunk) if before is None else now.join(before.select(chunk, "digest"), [chunk, "digest"], "left_anti").select(chunk)


def merged_chunks(chunks: DataFrame, question: str, sample: str, chunk: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(all rows, one row of ``questions, samples, chunks, digest``) of a table of chunks.

    The digest is of the chunks' digests in order, each of its ordered sample ids; a chunk
    has a fixed size, so no task holds more than one chunk's ids.
    """
    per = chunks.groupBy(chunk).agg(F.array_sort(F.collect_list(F.struct(order, sample))).alias("_l"))
    digests = per.select(chunk, ordered_digest(F.transform("_l", lambda x: x[sample])).alias("_d"))
    total = digests.agg(F.count("*").alias("chunks"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(chunk, "_d"))), lambda x: x["_d"]), ","), 256).alias("digest"))
    sizes = chunks.agg(F.count_distinct(question).alias("questions"), F.count("*").alias("samples"))
    return chunks, sizes.crossJoin(total)
