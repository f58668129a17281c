"""How text filters interact: what each removes in every order they may be applied in.

Five filters give each document a number of five bits, a bit for each one that it fails. A
table of 32 rows (such numbers) and 120 columns (orders) holds the step at which a document
is removed first. Tasks look their documents up in it and count (part, order, step) with
``np.bincount``, once for all documents and once for each label; the arrays are added up as
a tree, and everything else follows from them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import bound_batches, tidied, tree_summed

FILTERS = "ABCDE"
ORDERS = list(itertools.permutations(range(len(FILTERS))))
STEPS = len(FILTERS)
MASKS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 100, 80, 10
#: All documents, those of good quality, and toxic ones are counted apart.
LABELS = 3
#: Parts whose arrays a task holds at most (18 KB each) before it hands them on.
HELD_PARTS = 256
#: Salts that null ids are dealt by, as a join would put them together.
SALTS = 1024


def first_failures() -> np.ndarray:
    """``[mask, order]``: the step (from 0) that removes the document, ``STEPS`` if none does."""
    table = np.full((MASKS, len(ORDERS)), STEPS, np.int64)
    for mask in range(MASKS):
        for at, order in enumerate(ORDERS):
            table[mask, at] = next((step for step, filter_ in enumerate(order) if mask >> filter_ & 1), STEPS)
    return table


def failed_filters(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``doc, part, mask, digest``: bits of filters A to D, which need the text alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(lang_col), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = [
        F.size("words") < LEAST_WORDS,
        F.size(F.array_distinct("words")).cast("long") * 100 < F.size("words").cast("long") * LEAST_DISTINCT_PERCENT,
        capitals.cast("long") * 100 > F.length("text").cast("long") * MOST_CAPITALS_PERCENT,
        F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))
    return rows.select("doc", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Rows with ``label``: 1 for good quality, 2 for toxic, their sum for both."""
    marks = [F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c) for c in ("quality", "toxic")]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(*marks).withColumn("salt", F.lit(0))
    salt = F.when(F.col("doc").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).otherwise(0)
    joined = rows.withColumn("salt", salt).join(known, ["doc", "salt"], "left")
    return joined.withColumn("label", F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0)) * 2).drop("quality", "toxic")


def copies_counted(rows: DataFrame) -> DataFrame:
    """``part, mask, label, n_first, n_copies``: rows by text, and how many fail filter E.

    The smallest id of a text stays (all its rows); null ids have no smaller one. Rows of a
    text are added up before they are shuffled by it, so one text may have any number.
    """
    each = rows.groupBy("doc", "salt", "digest", "part", "mask", "label").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "n"))).alias("first")
    loose = F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(0)).alias("loose")
    texts = each.groupBy("digest", "part", "mask", "label").agg(first, loose, F.sum("n").alias("n"))
    # a text has a row for each part and label here
    held = F.struct("part", "mask", "label", "first", "loose", "n")
    whole = texts.groupBy("digest").agg(F.min("first.doc").alias("least"), F.collect_list(held).alias("rows"))
    out = whole.select("least", F.explode("rows").alias("r")).select("least", "r.*")
    stays = F.col("loose") + F.when(F.col("first.doc") == F.col("least"), F.col("first.n")).otherwise(0)
    return out.select("part", "mask", "label", stays.alias("n_first"), (F.col("n") - stays).alias("n_copies"))


def _counted(rows: DataFrame) -> DataFrame:
    """``part, counts``: removals by (label, order, step), then documents by mask."""
    copy_bit, size = 1 << FILTERS.index("E"), LABELS * len(ORDERS) * (STEPS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = first_failures()
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "counts"])
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).dictionary_encode()
            code = np.tile(parts.indices.to_numpy(zero_copy_only=False).astype(np.int64), 2)
            mask = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            mask = np.concatenate([mask, mask | copy_bit])
            label = np.tile(batch.column(2).to_numpy(zero_copy_only=False), 2)
            n = np.concatenate([batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4)])
            names = parts.dictionary.to_pylist()
            cells = ((code[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (STEPS + 1) + table[mask]).ravel()
            each = len(ORDERS) * (STEPS + 1)
            # float64 weights are exact: a batch counts far fewer than 2**53 documents
            removals = [np.bincount(cells, np.repeat(np.where(chosen, n, 0), len(ORDERS)), len(names) * each) for chosen in (True, label & 1, label & 2)]
            masks = np.bincount(code * MASKS + mask, n, len(names) * MASKS)
            for i, name in enumerate(names):
                total = held.setdefault(name, np.zeros(size + MASKS, np.int64))
                for k, counted in enumerate(removals):
                    total[k * each : (k + 1) * each] += counted[i * each : (i + 1) * each].astype(np.int64)
                total[size:] += masks[i * MASKS : (i + 1) * MASKS].astype(np.int64)
            if len(held) >= HELD_PARTS:
                yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(tidied(run), "part string, counts binary")


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _reported(part: str, counts: np.ndarray) -> pa.RecordBatch:
    """The 600 rows of a part."""
    orders = np.array(ORDERS)
    by_label = counts[:-MASKS].reshape(LABELS, len(ORDERS), STEPS + 1)[:, :, :STEPS]
    removed, masks = by_label[0], counts[-MASKS:]
    fails = np.array([masks[[m for m in range(MASKS) if m >> f & 1]].sum() for f in range(STEPS)])
    alone = masks[[1 << f for f in range(STEPS)]]
    shapley = np.array([removed[orders == f].sum() for f in range(STEPS)])
    columns = [masks.sum() - np.cumsum(removed, axis=1), removed, fails[orders] - removed, alone[orders], by_label[1], by_label[2], shapley[orders]]
    names = ["".join(FILTERS[f] for f in order) for order in ORDERS for _ in range(STEPS)]
    keys = [pa.array([part] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(list(range(1, STEPS + 1)) * len(ORDERS), pa.int32())]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(c.ravel().astype(np.int64)) for c in columns)], [c.split()[0] for c in RESULT.split(", ")])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per part (value of ``lang_col``), order of the five filters and step.

    ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` count the
    part's documents: left after the step, removed by it, failing its filter but removed
    before, failing only this filter, removed here with a label ``quality`` 1 or ``toxic`` 1,
    and removed by this filter in all orders together. Zeros are rows too. A null text is
    empty (it fails A alone, and E if an empty text has a smaller id); a null part is the
    empty string; a null id has no label and is never a later copy. Rows that repeat an id
    count each, and rows of one text and id stay together. Of several labels of an id any
    may be 1. Texts of any length are read whole. Without documents there are no rows.
    """
    bound_batches(docs.sparkSession)
    rows = copies_counted(_labelled(failed_filters(docs, id_col, text_col, lang_col), labels, id_col))
    whole = tree_summed(_counted(rows), ["part"])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _reported(part, np.frombuffer(counts, np.int64))

    return whole.mapInArrow(tidied(report), RESULT)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
     'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS f
  FROM d LEFT JOIN marks USING (doc_id)
), counted AS (
  SELECT part, f.A::INT::VARCHAR || f.B::INT::VARCHAR || f.C::INT::VARCHAR || f.D::INT::VARCHAR || f.E::INT::VARCHAR AS bits,
    count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM failed GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(s AS INT) AS step, substr(filter_order, CAST(s AS INT), 1) AS own FROM orders, range(1, 6) AS r(s)
), seen AS (
  SELECT *, bits[ascii(own) - 64] = '1' AS fails, list_bool_or(list_transform(range(1, step), lambda i: bits[ascii(substr(filter_order, i, 1)) - 64] = '1')) AS gone_before,
    list_bool_or(list_transform(range(1, step + 1), lambda i: bits[ascii(substr(filter_order, i, 1)) - 64] = '1')) AS gone_after FROM counted, steps
), summed AS (
  SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (NOT coalesce(gone_after, false)), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (fails AND NOT coalesce(gone_before, false)), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fails AND coalesce(gone_before, false)), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails AND len(replace(bits, '0', '')) = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n_good) FILTER (fails AND NOT coalesce(gone_before, false)), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n_toxic) FILTER (fails AND NOT coalesce(gone_before, false)), 0) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM summed
"""
