"""Benchmark decontamination by template windows. Built-in column expressions only.

A text becomes tokens, and each token its template form: a number ``<number>``, a unit
after a number ``<unit>``, a capitalised word inside a sentence ``<name>``, anything else
itself in lower case. Windows of ``window`` template tokens are hashed and joined with those
of the benchmark, so a question with other numbers, names or units still meets its item.
Then slots are checked: along one alignment of document and item, equal slot values of the
item must stand for equal values of the document. Only consistent alignments count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import Scratch, sent_if_small
from plurality.llm.native import let

# A token is a number (with grouping, decimals, and letters attached) or a run of letters
# and digits; a stop between digits is no end of a sentence.
CORE = r"[0-9]+(?:[.,][0-9]+)*[\p{L}\p{N}]*|[\p{L}\p{N}]+"
#: The same for Java, where only a possessive group repeats without a call a repeat.
JAVA_CORE = CORE.replace("[0-9]+)*", "[0-9]++)*+")
SENTENCE_END = r"(?:[!?\n]|\.(?![0-9])|(?<![0-9])\.)[^\p{L}\p{N}]*"
MARK = "\x01"
UNITS = (
    "percent km kilometers kilometres m meters metres cm mm miles mile feet foot inches inch yards "
    "kg kilograms g grams mg tons pounds pound ounces l liters litres ml gallons "
    "seconds second minutes minute hours hour days day weeks week months month years year "
    "dollars dollar cents cent euros euro degrees mph kmh"
).split()
WINDOW = 8
#: A window must have this many literal tokens, so that it is not a pattern of slots alone.
LEAST_LITERALS = 4
#: How a window meets an item's: by template, by template with a capital at the beginning of
#: a sentence as a name too, or word for word.
KINDS = PLAIN, NAMES, LITERAL = 0, 1, 2
TOKENS, HASHES = ("forms", "names", "raws"), ("hash0", "hash1", "hash2")
#: The share of an item's windows that a document must hold.
LEAST_SHARE = 0.25
#: A run of this many tokens along one alignment is reported, whatever share of the item it is.
LONG_RUN = 13
#: Hashes of benchmark windows up to this number are sent to every executor (16 bytes each,
#: before the room that a hash table leaves free); more are shuffled.
BROADCAST_WINDOWS = 2_000_000


def _tokens(text: Column) -> Column:
    """Tokens of a text; the first one of a sentence has ``MARK`` before it."""
    marked = F.regexp_replace(F.translate(text, MARK, " "), SENTENCE_END, MARK)
    return F.regexp_extract_all(marked, F.lit(f"{MARK}?(?:{JAVA_CORE})"), F.lit(0))


def _forms(text: Column) -> Column:
    """``struct<forms, names, raws, hash0, hash1, hash2>`` of arrays.

    ``names`` are forms with a capitalised word as ``<name>`` at the beginning of a sentence
    too; ``raws`` are the tokens in lower case. The hashes are of those three, token by token.
    """

    def form(words: Column) -> Column:
        def digit(word: Column) -> Column:
            return (word >= "0") & (word < ":")

        def one(word: Column, i: Column) -> Column:
            low = F.lower(word)
            measured = low.isin(UNITS) & (i > 0) & digit(F.translate(F.get(words, i - 1), MARK, ""))
            core = F.substring(word, F.lit(2), F.length(word))
            # a capital is lower-cased at the beginning of a sentence, and a name inside
            first = F.when(digit(core), "<number>").when(F.lower(core).isin(UNITS) & (i > 0) & digit(F.translate(F.get(words, i - 1), MARK, "")), "<unit>").otherwise(F.lower(core))
            letter = F.substring(word, 1, 1)
            inner = F.when((i > 0) & (letter != F.lower(letter)), "<name>").otherwise(low)
            return F.when(digit(word), "<number>").when(word.startswith(MARK), first).when(measured, "<unit>").when(word == low, word).otherwise(inner)

        def name(plain: Column, i: Column) -> Column:
            # differs from the form only where a sentence begins with a capital
            word = F.get(words, i)
            begins = (i == 0) | word.startswith(MARK)
            letter = F.substring(F.translate(word, MARK, ""), 1, 1)
            return F.when(begins & ~plain.startswith("<") & (letter != F.lower(letter)), "<name>").otherwise(plain)

        raws = F.transform(words, lambda w: F.lower(F.when(w.startswith(MARK), F.substring(w, F.lit(2), F.length(w))).otherwise(w)))
        arrays = let(F.transform(words, one), lambda forms: F.struct(forms.alias("forms"), F.transform(forms, name).alias("names"), raws.alias("raws")))
        hashes = lambda t: (F.transform(t[c], lambda w: F.xxhash64(w)).alias(f"hash{k}") for k, c in enumerate(("forms", "names", "raws")))
        return let(arrays, lambda t: F.struct(t["forms"].alias("forms"), t["names"].alias("names"), t["raws"].alias("raws"), *hashes(t)))

    return let(_tokens(text), form)


def _chosen(arrays: tuple[str, str, str]) -> Column:
    """Of three arrays the one that windows of the row's kind are cut from."""
    return F.when(F.col("kind") == PLAIN, F.col(arrays[0])).when(F.col("kind") == NAMES, F.col(arrays[1])).otherwise(F.col(arrays[2]))


def _windows(rows: DataFrame, keep: list[str], text: Column, cuts: list[tuple[Column, int]]) -> DataFrame:
    """``keep`` columns, ``forms``, ``names``, ``raws``, and ``at, width, kind, hash`` of windows.

    ``cuts`` are widths and kinds. Tokens are found once a row. Windows are cut from their
    arrays by compiled code, and only those that a later join keeps get their tokens copied.
    """
    tokens = rows.select(*keep, _forms(text).alias("t")).select(*keep, *(f"t.{c}" for c in TOKENS + HASHES))
    n, each = F.size("forms"), len(cuts)
    numbers = F.when(n > 0, F.sequence(F.lit(0), n * each - 1)).otherwise(F.array().cast("array<int>"))
    nth = tokens.select(*keep, *TOKENS, *HASHES, F.explode(numbers).alias("nth"))
    cut = F.pmod("nth", F.lit(each))
    width, kind = cuts[0][0], F.lit(cuts[0][1])
    for i, (w, k) in enumerate(cuts[1:], 1):
        width, kind = F.when(cut == i, w).otherwise(width), F.when(cut == i, F.lit(k)).otherwise(kind)
    placed = nth.withColumn("at", F.floor(F.col("nth") / each).cast("int") + 1).withColumn("width", width).withColumn("kind", kind).drop("nth")
    inside = placed.where(F.col("at") + F.col("width") - 1 <= F.size("forms"))
    return inside.withColumn("hash", F.xxhash64("kind", F.slice(_chosen(HASHES), F.col("at"), F.col("width"))))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, kind, at, hash, width, tokens, raws`` of windows that can tell an item, and totals.

    Templates need literals; word for word every window counts, however short its item.
    ``total0`` to ``total2`` count the item's windows of each kind.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    width = F.least(F.size("forms"), F.lit(window))
    cut = _windows(benchmark.select(F.col(item_col).alias("item"), text.alias("text")), ["item"], F.col("text"), [(width, kind) for kind in KINDS])
    part = lambda c: F.slice(c, F.col("at"), F.col("width"))
    rows = cut.select("item", "kind", "at", "hash", "width", F.size("forms").alias("n"), part(_chosen(TOKENS)).alias("tokens"), part(F.col("raws")).alias("raws"))
    literal = F.size(F.filter("tokens", lambda f: ~f.startswith("<")))
    told = (F.col("n") >= LEAST_LITERALS) & (literal >= F.least(F.lit(LEAST_LITERALS), "width"))
    rows = rows.where((F.col("kind") == LITERAL) | told).drop("n").distinct()
    totals = rows.groupBy("item").agg(*(F.count(F.when(F.col("kind") == kind, 1)).alias(f"total{kind}") for kind in KINDS))
    return rows.join(totals, "item")


#: A window of a document whose hash the benchmark has.
SPOT = ("doc", "doc_at", "hash", "doc_tokens", "doc_raws")


def _far_spots(source: DataFrame, hashes: DataFrame, cuts: list[tuple[Column, int]], scratch: Scratch) -> DataFrame:
    """Windows with a hash of ``hashes`` where those are too many to be sent.

    Only a number for the row, the place and the hash are shuffled. Then each document found
    is read again with all its places, so its tokens travel once. The number is of the row's
    content: should two rows share one, both look at all places, and tokens decide.
    """
    keyed = source.select(F.xxhash64("doc", "text").alias("key"), "doc", "text")
    cut = _windows(keyed, ["key"], F.col("text"), cuts)
    places = cut.select("key", F.struct(F.col("at").alias("doc_at"), F.col("width").alias("_w"), "kind", "hash").alias("place"), "hash").join(hashes, "hash", "left_semi")
    of_row = scratch.keep(places.groupBy("key").agg(F.collect_set("place").alias("places")))  # at most the row's windows
    wanted = keyed.join(sent_if_small(of_row.select("key"), scratch), "key", "left_semi")
    tokens = wanted.select("key", "doc", _forms(F.col("text")).alias("t")).select("key", "doc", *(f"t.{c}" for c in TOKENS))
    kinds = lambda p: F.when(p["kind"] == PLAIN, F.col("forms")).when(p["kind"] == NAMES, F.col("names")).otherwise(F.col("raws"))
    cut_out = lambda p: F.struct(p["doc_at"], p["hash"], F.slice(kinds(p), p["doc_at"], p["_w"]), F.slice("raws", p["doc_at"], p["_w"]))
    spots = tokens.join(of_row, "key").select("doc", F.explode(F.transform("places", cut_out)).alias("s"))
    return spots.select("doc", "s.*").toDF(*SPOT)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """One row per document and item found in it: ``id, item, n_windows, item_windows``.

    ``n_windows`` counts the item's windows found along consistent alignments; a pair is
    reported if they are at least ``least_share`` of ``item_windows``. Three counts are
    looked at, and the first that suffices is shown: templates; templates with a capital at
    the beginning of a sentence as a name; and all windows of the item, found by a template
    or word for word in any letter case. These are also shown for a pair with ``LONG_RUN``
    tokens or more in a row along one alignment, whatever their share. An item of fewer than ``window`` tokens is one
    window. A template has ``LEAST_LITERALS`` literals at least; other windows, and items of
    fewer tokens, are found word for word only. Null and empty texts hold nothing; texts of any
    length are read whole, their tokens once. Rows with
    the same document id (a null one too) count together, and so do rows of one item.
    ``oracle_sql`` says the first count only, so pairs found by the others are not in it.
    """
    scratch = Scratch(docs.sparkSession)
    known = scratch.keep(benchmark_windows(benchmark, item_col, item_text_col, window))
    sizes = known.groupBy("width", "kind").count().collect()  # at most 3 x `window` rows
    hashes = known.select("hash").distinct()
    sent = sum(r["count"] for r in sizes) <= BROADCAST_WINDOWS
    source = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = [(F.lit(w), k) for w, k in sorted({(r["width"], r["kind"]) for r in sizes}) or [(window, PLAIN)]]
    if sent:
        part = lambda c: F.slice(c, F.col("at"), F.col("width"))
        cut = _windows(source, ["doc"], F.col("text"), cuts).join(F.broadcast(hashes), "hash", "left_semi")
        spots = cut.select("doc", "at", "hash", part(_chosen(TOKENS)), part("raws")).toDF(*SPOT)
    else:
        spots = _far_spots(source, hashes, cuts, scratch)
    spots = scratch.keep(spots)
    hit = spots.join(known, "hash")
    # said as an order, and null-safe: an equation would become part of the join key
    alike = F.coalesce((F.col("doc_tokens") >= F.col("tokens")) & (F.col("doc_tokens") <= F.col("tokens")), F.lit(False))
    totals = [f"total{kind}" for kind in KINDS]
    found = hit.where(alike).select("doc", "item", "kind", (F.col("doc_at") - F.col("at")).alias("shift"), "at", *totals, "tokens", "raws", "doc_raws")
    slots = F.filter(F.arrays_zip(F.col("tokens").alias("form"), F.col("raws").alias("item"), F.col("doc_raws").alias("doc")), lambda s: s["form"].startswith("<"))
    bound = F.array_distinct(F.transform(slots, lambda s: F.struct(s["form"].alias("form"), s["item"].alias("item"), s["doc"].alias("doc"))))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    joined = lambda sets: F.array_distinct(F.flatten(sets))
    # along one alignment there are no more windows and slots than the item has
    along = found.select("doc", "item", "kind", "shift", "at", *totals, bound.alias("bound")).groupBy("doc", "item", "shift").agg(
        *(F.collect_set(of(kind, "at")).alias(f"at{kind}") for kind in KINDS),
        *(F.max(total).alias(total) for total in totals),
        joined(F.collect_set(of(PLAIN, "bound"))).alias("bound"),
        joined(F.collect_set("bound")).alias("every"),
    )
    steady = lambda c: F.size(c) == F.size(F.array_distinct(F.transform(c, lambda s: F.struct(s["form"], s["item"]))))
    # values that break the plain templates break the whole alignment
    sound = along.where(steady("bound")).withColumn(f"at{NAMES}", F.when(steady("every"), F.col(f"at{NAMES}")).otherwise(F.array().cast("array<int>")))
    sound = sound.withColumn("any", F.array_union(F.array_union(f"at{PLAIN}", f"at{NAMES}"), f"at{LITERAL}"))
    more = max(LONG_RUN - window, 0)
    run = lambda at: F.when(F.size(at) > more, F.exists(F.sequence(F.lit(1), F.size(at) - more), lambda i: F.element_at(at, i + more) - F.element_at(at, i) == more))
    sound = sound.withColumn("long", let(F.sort_array("any"), run))
    places = {PLAIN: f"at{PLAIN}", NAMES: f"at{NAMES}", LITERAL: "any"}
    counted = sound.groupBy("doc", "item").agg(
        *(F.size(joined(F.collect_set(place))).alias(f"n{kind}") for kind, place in places.items()),
        *(F.max(total).alias(total) for total in totals),
        F.max("long").alias("long"),
    )
    enough = lambda kind: (F.col(f"n{kind}") > 0) & (F.col(f"n{kind}") >= least_share * F.col(f"total{kind}"))
    count = lambda kind: F.struct(F.col(f"n{kind}").cast("long").alias("n_windows"), F.col(f"total{kind}").alias("item_windows"))
    best = F.when(enough(PLAIN), count(PLAIN)).when(enough(NAMES), count(NAMES)).when(enough(LITERAL) | F.col("long"), count(LITERAL))
    shown = counted.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), best.alias("best"))
    return shown.where(F.col("best").isNotNull()).select(id_col, item_col, "best.n_windows", "best.item_windows")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with a null id stay."""
    found = contaminated(docs, benchmark, id_col, text_col, **parameters).select(F.col(id_col)).distinct()
    bad = sent_if_small(found, Scratch(docs.sparkSession))
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)


def oracle_sql(window: int = WINDOW) -> str:
    """The same over the tables ``documents`` and ``benchmark``, for DuckDB."""
    token = rf"([.!?\n][^\p{{L}}\p{{N}}]*)?({CORE})"
    units = ", ".join(f"'{u}'" for u in UNITS)

    def forms(source: str, key: str) -> str:
        return f"""{source}_words AS (
  SELECT {key}, regexp_extract_all(coalesce(text, ''), '{token}', 2) AS core, regexp_extract_all(coalesce(text, ''), '{token}', 1) AS head
  FROM {source}
), {source}_forms AS (
  SELECT {key}, list_transform(core, lambda c: lower(c)) AS raws, list_transform(range(1, len(core) + 1), lambda i: CASE
    WHEN core[i] >= '0' AND core[i] < ':' THEN '<number>'
    WHEN i > 1 AND core[i - 1] >= '0' AND core[i - 1] < ':' AND lower(core[i]) IN ({units}) THEN '<unit>'
    WHEN substr(core[i], 1, 1) <> lower(substr(core[i], 1, 1)) AND i > 1 AND coalesce(head[i], '') = '' THEN '<name>'
    ELSE lower(core[i]) END) AS forms
  FROM {source}_words
)"""

    return f"""
WITH {forms("documents", "doc_id")}, {forms("benchmark", "item_id")},
item_cut AS (
  SELECT DISTINCT item_id, least(len(forms), {window}) AS width, i AS at, forms[i:i + least(len(forms), {window}) - 1] AS forms, raws[i:i + least(len(forms), {window}) - 1] AS raws
  FROM benchmark_forms, unnest(range(1, len(forms) - least(len(forms), {window}) + 2)) AS u(i)
  WHERE len(forms) >= {LEAST_LITERALS}
), items AS (
  SELECT *, count(*) OVER (PARTITION BY item_id) AS total FROM item_cut
  WHERE len(list_filter(forms, lambda f: NOT starts_with(f, '<'))) >= least({LEAST_LITERALS}, width)
), doc_cut AS (
  SELECT doc_id, w.width, i AS at, forms[i:i + w.width - 1] AS forms, raws[i:i + w.width - 1] AS raws
  FROM documents_forms, (SELECT DISTINCT width FROM items) w, unnest(range(1, len(forms) - w.width + 2)) AS u(i)
  WHERE len(forms) >= w.width
), hits AS (
  SELECT d.doc_id, b.item_id, d.at - b.at AS shift, b.at, b.total, b.forms, b.raws AS item_raws, d.raws AS doc_raws
  FROM doc_cut d JOIN items b ON d.width = b.width AND d.forms = b.forms
), slots AS (
  SELECT doc_id, item_id, shift, forms[k] AS form, item_raws[k] AS item_value, doc_raws[k] AS doc_value
  FROM hits, unnest(range(1, len(forms) + 1)) AS u(k) WHERE starts_with(forms[k], '<')
), broken AS (
  SELECT DISTINCT doc_id, item_id, shift FROM slots GROUP BY doc_id, item_id, shift, form, item_value HAVING count(DISTINCT doc_value) > 1
)
SELECT h.doc_id, h.item_id, count(DISTINCT h.at) AS n_windows, max(total) AS item_windows
FROM hits h WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE b.doc_id IS NOT DISTINCT FROM h.doc_id AND b.item_id = h.item_id AND b.shift = h.shift)
GROUP BY h.doc_id, h.item_id HAVING count(DISTINCT h.at) >= {LEAST_SHARE} * max(total)
"""
