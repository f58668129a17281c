"""Chat formatting by quotation linking, in built-in column expressions.

A line's quote level is the number of ``>`` before it. Paragraphs of one level are the
quoted passages (level 1 and up) and a message's own passages (level 0). Passages and their
single lines are normalised (lower case, white space as one blank) and hashed; a quoted
hash is joined to the earliest message of the conversation that says it itself. The lowest
matched level names the message replied to. Replies form threads; messages come out without
their quotes, with the keys that put a thread in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import Scratch, hot_join
from plurality.llm.native import let

# What stands before a line's text; the marks end at the last ">" of it.
MARKS = r"^[\x20\t>]*+"
# Fixed value: a line that says who wrote the quote below it.
ATTRIBUTION = r"^ *(On|Am|Le|El) .*(wrote|schrieb|a écrit|escribió) ?: *$"
#: Salts that rows without a key are dealt by, as a join would put them together.
SALTS = 1024


def _lines(text: Column) -> Column:
    """Array of ``struct<level, body>``, one for each line."""

    def one(line: Column) -> Column:
        marks = F.rtrim(F.regexp_extract(line, MARKS, 0), F.lit(" \t"))
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(level.alias("level"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("body"))

    # a line that only introduces a deeper quote is of no level
    def marked(lines: Column) -> Column:
        below = lambda i: F.coalesce(F.get(lines, i + 1)["level"], F.lit(0))
        introduces = lambda x, i: (below(i) > x["level"]) & x["body"].rlike(ATTRIBUTION)
        return F.transform(lines, lambda x, i: F.struct(F.when(introduces(x, i), -1).otherwise(x["level"]).alias("level"), x["body"].alias("body")))

    return let(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), one), marked)


def _normal(passage: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(passage, r"[\x20\x09-\x0D]+", " ")))


def _passages(lines: Column) -> Column:
    """``level:passage`` of normalised paragraphs and lines, each once; blank ones left out.

    A paragraph is a run of lines of one level that are not blank, so a line is in one
    paragraph only, however many levels there are.
    """
    told = lambda i: F.trim(F.get(lines, i)["body"]) != ""
    goes_on = lambda i, j: F.coalesce(told(j) & (F.get(lines, i)["level"] == F.get(lines, j)["level"]), F.lit(False))
    places = F.filter(F.transform(lines, lambda x, i: i), told)
    begins, ends = F.filter(places, lambda i: ~goes_on(i, i - 1)), F.filter(places, lambda i: ~goes_on(i, i + 1))
    said = lambda level, body: F.concat(level.cast("string"), F.lit(":"), _normal(body))
    whole = lambda x: F.array_join(F.transform(F.slice(lines, x["b"] + 1, x["e"] - x["b"] + 1), lambda y: F.trim(y["body"])), "\n")
    runs = F.arrays_zip(begins.alias("b"), ends.alias("e"))
    paragraphs = F.transform(runs, lambda x: said(F.get(lines, x["b"])["level"], whole(x)))
    every = F.array_distinct(F.concat(paragraphs, F.transform(lines, lambda x: said(x["level"], x["body"]))))
    return F.filter(every, lambda p: F.length(p) > F.instr(p, ":"))


def _of(passage: Column) -> tuple[Column, Column]:
    """Level and passage of ``level:passage``."""
    at = F.instr(passage, ":")
    return F.substring(passage, F.lit(1), at - 1).cast("int"), F.substring(passage, at + 1, F.length(passage))


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, role, body, own, quoted``: text without quotes, and ``level:passage`` of
    what the message says itself and of what it quotes."""

    def pieces(lines: Column) -> Column:
        body = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
        of = lambda passages: F.struct(F.filter(passages, lambda p: p.startswith("0:")).alias("own"), F.filter(passages, lambda p: ~p.startswith("0:") & ~p.startswith("-")).alias("quoted"))
        return F.struct(F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"), let(_passages(lines), of).alias("said"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), let(_lines(text), pieces).alias("p"))
    return rows.select("conv", "turn", "role", "p.body", "p.said.own", "p.said.quoted")


def _roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv, turn, parent, n_linked, root, depth`` by doubling: a turn takes over its
    ancestor's. One root may have any number of replies, so it is met by ``hot_join``."""
    state = scratch.keep(parents.select("conv", "turn", "parent", "n_linked", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    total = state.count()
    while True:
        uses = state.groupBy("conv", "root").agg(F.count("*").alias("uses"))
        far = state.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more")).join(uses, ["conv", "root"])
        met = hot_join(state, far, ["conv", "root"], F.col("uses"), total, how="left")
        moved = F.col("above").isNotNull().alias("moved")
        after = scratch.keep(met.select("conv", "turn", "parent", "n_linked", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), moved))
        scratch.drop(state)
        if not after.where("moved").limit(1).count():
            return after.drop("moved")
        state = after


def reply_threads(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: ``conv, turn, role, body, n_quotes, n_linked, parent_turn,
    thread_turn, depth, formatted``.

    ``(conv, thread_turn, turn)`` sorts each conversation by threads, and a thread by turn: a
    reply always comes after what it answers, in the thread begun by ``thread_turn``, and
    side branches of one thread stand in the order they were written, not one after the
    other; a message that answers none begins its own (depth 0). A message answers only earlier turns of its
    conversation; of several at its lowest linked level, the latest. ``n_quotes`` counts
    distinct quoted passages and lines, ``n_linked`` those found. A line like "On Monday Ann
    wrote:" above a deeper quote belongs to no one and is left out. ``formatted`` is the role
    tag and the body. Null text: an empty body; null role: ``unknown``; rows with a null
    conversation or turn are never linked; repeated rows stay, and rows of one turn share a
    parent; a passage said in several turns is the earliest one's. Conversations are never
    gathered: order is given by keys, so one may be of any size, and so may a text.
    """
    scratch = Scratch(messages.sparkSession)
    rows = parsed(messages, conv_col, turn_col, role_col, text_col)
    quoted = rows.where((F.size("quoted") > 0) & F.col("conv").isNotNull() & F.col("turn").isNotNull()).select("conv", "turn", F.explode("quoted").alias("q"))
    level, passage = _of(F.col("q"))
    quotes = scratch.keep(quoted.select("conv", "turn", level.alias("level"), passage.alias("passage")).distinct().withColumn("hash", F.xxhash64("passage")))
    kinds, total = dict(rows.dtypes), quotes.count()
    if total:
        key = ["conv", "hash", "passage"]
        own = rows.select("conv", "turn", F.explode("own").alias("q")).select("conv", "turn", _of(F.col("q"))[1].alias("passage"))
        said = own.groupBy("conv", F.xxhash64("passage").alias("hash"), "passage").agg(F.min("turn").alias("origin"))
        uses = quotes.groupBy(*key).agg(F.count("*").alias("uses"))
        links = hot_join(quotes, said.join(uses, key), key, F.col("uses"), total).where("origin < turn")
        per_turn = links.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), F.col("origin"))).alias("best"), F.count("*").alias("n_linked"))
        linked = _roots(per_turn.select("conv", "turn", F.col("best.origin").alias("parent"), "n_linked"), scratch)
    else:
        spec = f"conv {kinds['conv']}, turn {kinds['turn']}, parent {kinds['turn']}, n_linked long, root {kinds['turn']}, depth int"
        linked = messages.sparkSession.createDataFrame([], spec)
    scratch.drop(quotes)
    role = F.coalesce("role", F.lit("unknown"))
    keyless = F.col("conv").isNull() | F.col("turn").isNull()
    salted = rows.withColumn("salt", F.when(keyless, F.pmod(F.xxhash64("body"), F.lit(SALTS)) + 1).otherwise(0))
    out = salted.join(linked.withColumn("salt", F.lit(0).cast("long")), ["conv", "turn", "salt"], "left").select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        "body",
        F.size("quoted").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("body"), F.lit("\n")).alias("formatted"),
    )
    return out


ORACLE_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT conv_id, turn, role, list_transform(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)), lambda line:
    {'level': length(regexp_extract(line, '^(?:[ \t]*>)+')) - length(replace(regexp_extract(line, '^(?:[ \t]*>)+'), '>', '')),
     'body': substr(line, length(regexp_extract(line, '^(?:[ \t]*>)+')) + 1)}) AS plain
  FROM conversations
), marked AS (
  SELECT conv_id, turn, role, list_transform(plain, lambda x, i: {'level': CASE WHEN coalesce(plain[i + 1].level, 0) > x.level
    AND regexp_matches(x.body, '^ *(On|Am|Le|El) .*(wrote|schrieb|a écrit|escribió) ?: *$') THEN -1 ELSE x.level END, 'body': x.body}) AS lines FROM cut
), messages AS (
  SELECT *, regexp_replace(array_to_string(list_transform(list_filter(lines, lambda x: x.level = 0), lambda x: x.body), chr(10)), '^\s+|\s+$', '', 'g') AS body FROM marked
), flat AS (
  SELECT DISTINCT conv_id, turn, l AS level, array_to_string(list_transform(lines, lambda x: CASE WHEN x.level = l THEN trim(x.body, ' ') ELSE '' END), chr(10)) AS kept
  FROM messages, unnest(range(0, list_max(list_transform(lines, lambda x: x.level)) + 1)) AS u(l)
), passages AS (
  SELECT DISTINCT conv_id, turn, level, lower(trim(regexp_replace(p, '[ \x09-\x0D]+', ' ', 'g'), ' ')) AS passage
  FROM flat, unnest(list_concat(string_split_regex(kept, '\n\n+'), string_split(kept, chr(10)))) AS u(p)
), told AS (
  SELECT conv_id, turn, level, passage FROM passages WHERE passage <> ''
), said AS (
  SELECT conv_id, passage, min(turn) AS origin FROM told WHERE level = 0 GROUP BY ALL
), links AS (
  SELECT q.conv_id, q.turn, q.level, s.origin FROM told q JOIN said s USING (conv_id, passage) WHERE q.level > 0 AND s.origin < q.turn
), chosen AS (
  SELECT conv_id, turn, (max({'level': -level, 'origin': origin})).origin AS parent, count(*) AS n_linked FROM links GROUP BY ALL
), climb AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM chosen
  UNION ALL
  SELECT c.conv_id, c.turn, p.parent, c.depth + 1 FROM climb c JOIN chosen p ON p.conv_id = c.conv_id AND p.turn = c.root
), tops AS (
  SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM climb GROUP BY ALL
)
SELECT m.conv_id, m.turn, m.role, m.body,
  (SELECT count(*) FROM told t WHERE t.conv_id IS NOT DISTINCT FROM m.conv_id AND t.turn IS NOT DISTINCT FROM m.turn AND t.level > 0) AS n_quotes,
  coalesce(c.n_linked, 0) AS n_linked, c.parent AS parent_turn, coalesce(t.root, m.turn) AS thread_turn, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth,
  '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || m.body || chr(10) AS formatted
FROM messages m LEFT JOIN chosen c USING (conv_id, turn) LEFT JOIN tops t USING (conv_id, turn)
"""
