"""Chat formatting by quotation linking: quoted passages are hashed and joined to the messages they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgrain.llm.common import bounded, cut, lookup

#: Messages of one part of a conversation.
PART = 1024


def markers(line: Column) -> Column:
    """The quote markers that a line begins with: '>' signs, each with at most one space after it. Empty if it does not begin with one."""
    return F.when(F.startswith(line, F.lit(">")), F.substring_index(F.regexp_extract(line, "^[> ]*", 0), "  ", 1)).otherwise("")


def level(line: Column) -> Column:
    """How deep a line is quoted: its leading '>' signs, single spaces between them allowed; 0 for the author's own words."""
    return F.length(F.replace(markers(line), F.lit(" "), F.lit("")))


def normalised(line: Column) -> Column:
    """A line without markers, in lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.substr(line, F.length(markers(line)) + 1)), r"[\x20\x09-\x0D]+", " "))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, text, own (normalised lines of level 0) and runs (level and normalised lines of each maximal run of one level).

    A run starts where the level changes; its lines are a slice of the message's, so time is in proportion to the text.
    """
    rows = F.filter(F.transform(_split(F.col("text")), lambda x: F.struct(level(x).alias("level"), normalised(x).alias("words"))), lambda x: x["words"] != "")
    d = messages.select("conv_id", "turn", "text", rows.alias("lines"))
    d = d.select("conv_id", "turn", "text", F.transform("lines", lambda x: x["level"]).alias("levels"), F.transform("lines", lambda x: x["words"]).alias("words"))
    changes = lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1))
    d = d.withColumn("starts", F.when(F.size("levels") > 0, F.filter(F.sequence(F.lit(0), F.size("levels") - 1), changes)).otherwise(F.array().cast("array<int>")))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("words"))
    runs = F.transform("starts", lambda s, k: F.struct(F.get("levels", s).alias("level"), F.slice("words", s + 1, end(k) - s).alias("lines")))
    own = F.transform(F.filter(F.arrays_zip("levels", "words"), lambda x: x["levels"] == 0), lambda x: x["words"])
    return d.select("conv_id", "turn", "text", own.alias("own"), runs.alias("runs"))


def words_hash(lines: Column) -> Column:
    """Of a passage's words, however they are broken into lines."""
    return F.xxhash64(F.concat_ws(" ", lines))


def _pair(rung: str, half: int):
    return lambda i: F.xxhash64(F.get(rung, i), F.get(rung, i + half))


def _steps(most: int) -> int:
    return max(0, most.bit_length() - 1)


def ladder(d: DataFrame, lines: str, most: int) -> DataFrame:
    """Adds `rungs`: for each k the hashes of all stretches of 2^k consecutive lines, a stretch being two of half its length.

    A hash has 64 bits and is only ever compared within one conversation.
    """
    rungs = []
    for k in range(_steps(most) + 1):
        if not k:
            h = F.transform(lines, lambda x: F.xxhash64(x))
        else:
            size = 1 << k
            h = F.when(F.size(lines) >= size, F.transform(F.sequence(F.lit(0), F.size(lines) - size), _pair(f"__h{k - 1}", size // 2))).otherwise(F.array().cast("array<bigint>"))
        d = d.withColumn(f"__h{k}", h)
        rungs.append(f"__h{k}")
    return d.withColumn("rungs", F.array(*rungs)).drop(*rungs)


def stretch_hash(rungs: str, start: Column, n: Column, most: int) -> Column:
    """The hash of n lines from start on: of the two longest rungs that cover them."""
    k, size = F.lit(0), F.lit(1)
    for step in range(1, _steps(most) + 1):
        k, size = F.when(n >= (1 << step), step).otherwise(k), F.when(n >= (1 << step), 1 << step).otherwise(size)
    rung = F.get(F.col(rungs), k)
    return F.xxhash64(n, F.get(rung, start), F.get(rung, start + n - size))


def quoted(runs: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, turn, level, run, n, lines, words, stretch) of every different quoted run, cut, and the lines of the longest.

    run is the SHA-256 of its normalised lines joined by one space; words and stretch are what originals are joined by.
    """
    found = runs.select("conv_id", "turn", F.explode(F.array_distinct(F.filter("runs", lambda r: r["level"] > 0))).alias("p")).select("conv_id", "turn", "p.level", "p.lines")
    most = found.agg(F.max(F.size("lines")).alias("n")).first()["n"] or 0
    found = ladder(found, "lines", most)
    n = F.size("lines")
    return cut(found.select("conv_id", "turn", "level", F.sha2(F.concat_ws(" ", "lines"), 256).alias("run"), n.alias("n"), "lines", words_hash(F.col("lines")).alias("words"), stretch_hash("rungs", F.lit(0), n, most).alias("stretch"))), most


def originals(runs: DataFrame, quotes: DataFrame, most: int) -> DataFrame:
    """conv_id, n, hash and origin (earliest turn) of every passage of own words that a quote may repeat.

    With n = 0, by their words: whole own runs, paragraphs (between empty lines) and single lines; so a quote wrapped anew is
    found if it is one of these. With n > 0, for every number of lines that some quote of the conversation has, all stretches
    of so many consecutive own lines. All passages of a message are found within its row.
    """
    spans = cut(quotes.groupBy("conv_id").agg(F.array_sort(F.collect_set("n")).alias("spans")))
    rows = lookup(runs.where(F.size("own") > 0), spans, ["conv_id"], salt="turn")
    whole = F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: words_hash(r["lines"]))
    said = lambda p: F.filter(F.transform(F.filter(F.split(p, "\n", -1), lambda x: level(x) == 0), lambda x: normalised(x)), lambda x: x != "")
    paragraphs = F.transform(F.split(F.coalesce("text", F.lit("")), "\n[\\x20\\x09-\\x0D]*\n", -1), lambda p: words_hash(said(p)))
    by_words = F.transform(F.array_distinct(F.concat(whole, paragraphs, F.transform("own", lambda x: F.xxhash64(x)))), lambda h: F.struct(F.lit(0).alias("n"), h.alias("hash")))
    rows = rows.select("conv_id", "turn", F.size("own").alias("lines"), "own", "spans", by_words.alias("passages"))
    rows = ladder(rows, "own", most)
    starts = lambda n: F.when(F.col("lines") >= n, F.sequence(F.lit(0), F.col("lines") - n)).otherwise(F.array().cast("array<int>"))
    stretches = F.flatten(F.transform("spans", lambda n: F.transform(starts(n), lambda i: F.struct(n.alias("n"), stretch_hash("rungs", i, n, most).alias("hash")))))
    found = rows.select("conv_id", "turn", F.explode(F.concat("passages", stretches)).alias("p"))
    return found.groupBy("conv_id", "p.n", "p.hash").agg(F.min("turn").alias("origin")).select("conv_id", "n", "hash", "origin")


def linked(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quotes, links): every quoted run, and those found in an earlier message of the conversation, with the earliest such turn.

    A run that no message has as a whole, since lines were altered or added, is linked by its lines: each counts for the
    earliest message with it, and the message with most of them, the earlier one if two have as many, is the origin if they
    are half of the run at least. Originals are merged to one row per conversation and passage before the joins, so each
    quote and each line meets at most one. Messages are parsed once.
    """
    runs = cut(parsed(messages))
    quotes, most = quoted(runs)
    firsts = cut(originals(runs, quotes, most))
    by_words = firsts.where("n = 0").select("conv_id", F.col("hash").alias("words"), F.col("origin").alias("by_words"))
    by_lines = firsts.where("n > 0").select("conv_id", "n", F.col("hash").alias("stretch"), F.col("origin").alias("by_lines"))
    found = lookup(lookup(quotes, by_words, ["conv_id", "words"], "left", salt="turn"), by_lines, ["conv_id", "n", "stretch"], "left", salt="turn")
    found = found.withColumn("origin", F.least("by_words", "by_lines")).withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    found = cut(found.select("conv_id", "turn", "level", "run", "n", "origin", F.when(F.col("origin").isNull() & (F.col("n") > 1), F.col("lines")).alias("lines")))
    whole = found.where("origin is not null").select("conv_id", "run", "turn", "level", "origin")
    rest = found.where("lines is not null").select("conv_id", "turn", "level", "run", "n", F.explode("lines").alias("line")).withColumn("words", F.xxhash64("line"))
    rest = lookup(rest, by_words.withColumnRenamed("by_words", "origin"), ["conv_id", "words"], salt="turn").where(F.col("origin") < F.col("turn"))
    rest = rest.groupBy("conv_id", "turn", "level", "run", "n", "origin").agg(F.count(F.lit(1)).alias("hits"))
    rest = rest.groupBy("conv_id", "turn", "level", "run", "n").agg(F.max(F.struct("hits", (-F.col("origin")).alias("back"))).alias("p")).where("2 * p.hits >= n")
    return quotes, cut(whole.unionByName(rest.select("conv_id", "run", "turn", "level", (-F.col("p.back")).alias("origin"))))


def replies(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, anchor) of messages that quote an earlier one. links: the second result of linked.

    reply_to is the latest of the messages quoted at the lowest linked level (deeper quotes are of older messages). anchor is
    where following reply_to ends, at a message that quotes none: found by doubling, in as many rounds as the logarithm of
    the longest chain.
    """
    parent = links.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("origin")).alias("back"))).alias("p")).select("conv_id", "turn", (-F.col("p.back")).alias("reply_to"))
    chain = cut(parent.withColumn("anchor", F.col("reply_to")))
    while True:
        up = chain.select("conv_id", F.col("turn").alias("anchor"), F.col("anchor").alias("above"))
        step = cut(lookup(chain, up, ["conv_id", "anchor"], "left", salt="turn").select("conv_id", "turn", "reply_to", F.coalesce("above", "anchor").alias("anchor"), F.col("above").isNotNull().alias("moved")))
        chain = step.drop("moved")
        if step.where("moved").isEmpty():
            return chain


def _sortable(x: Column) -> Column:
    """16 hex digits that sort like the whole number, negative ones first; empty for null."""
    return F.coalesce(F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(""))


def quotation_links(messages: DataFrame) -> DataFrame:
    """Conversations in reply order without quotes; one row per row of messages.

    Columns: conv_id, turn, role, text (lines that are not quoted, joined again, spaces at both ends removed), reply_to,
    anchor (the turn that the chain of replies leads to; the own turn if it quotes none), reply_key (sorting by conv_id and
    reply_key gives reply order: a message follows the thread it belongs to, a thread's messages by turn), n_quotes (different
    quoted passages by level), n_linked (those found in an earlier message of the conversation), depth (deepest level). A null
    text is empty; rows with a null conv_id or turn are linked to nothing; repeated rows are one message to the others and
    give repeated rows; a table without rows gives none; columns other than these four are not read. A very long text takes
    time in proportion to its lines, times the number of different lengths of its conversation's quotes.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    named = rows.where("conv_id is not null and turn is not null")
    # only conversations with a quote need their originals hashed
    quoting = cut(named.where(F.exists(_split(F.col("text")), lambda x: F.startswith(x, F.lit(">")))).select("conv_id").distinct())
    quotes, links = linked(lookup(named.select("conv_id", "turn", "text"), quoting, ["conv_id"], "left_semi", salt="turn").distinct())
    counts = quotes.groupBy("conv_id", "turn").agg(F.count_distinct("level", "run").cast("long").alias("n_quotes"), F.max("level").cast("long").alias("depth"))
    hits = links.groupBy("conv_id", "turn").agg(F.count_distinct("level", "run").cast("long").alias("n_linked"))
    known = cut(counts.join(hits, ["conv_id", "turn"], "left").join(replies(links), ["conv_id", "turn"], "left"))
    out = rows.join(bounded(known), ["conv_id", "turn"], "left")
    plain = F.trim(F.array_join(F.filter(_split(F.col("text")), lambda x: level(x) == 0), "\n"))
    anchor = F.coalesce("anchor", "turn")
    return out.select(
        "conv_id", "turn", "role", plain.alias("text"), "reply_to", anchor.alias("anchor"), F.concat_ws(".", _sortable(anchor), _sortable(F.col("turn"))).alias("reply_key"),
        F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
    )


def placed(found: DataFrame) -> DataFrame:
    """Adds position: a message's place in the reply order of its conversation, from 0. found: the result of quotation_links.

    Rows are dealt by ranges of that order, so a conversation that holds a third of them lies in many tasks; each task counts
    its own, and a conversation that goes on from one range to the next adds what lies before: one row a range, broadcast.
    """
    order = [F.col("conv_id").asc_nulls_first(), "reply_key", F.col("role").asc_nulls_first(), "text"]
    ranged = cut(cut(found).repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__k")))
    # (a null conversation is one like the others)
    per = ranged.groupBy("conv_id", "__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    carried = cut(per.withColumn("__before", before).where("__before is not null").select(F.col("conv_id").alias("__conv"), F.col("__range").alias("__of"), "__before"))
    own = F.row_number().over(Window.partitionBy("__range", "conv_id").orderBy("__k")) - 1
    rows = ranged.withColumn("__own", own).join(bounded(carried), F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__range") == F.col("__of")), "left")
    return rows.withColumn("position", F.col("__own") + F.coalesce("__before", F.lit(0).cast("long"))).drop("__range", "__k", "__own", "__conv", "__of", "__before")


def conversations(messages: DataFrame, part: int = PART) -> DataFrame:
    """Chats in reply order without quotes: conv_id, part and messages (position, turn, role, text, reply_to), at most `part` a row.

    A long conversation has several rows, numbered from 0, so no row holds an unbounded group. Messages whose text was all
    quotes stay, with an empty text. Null conv_ids are one conversation; a table without rows gives none.
    """
    rows = placed(quotation_links(messages))
    said = F.array_sort(F.collect_list(F.struct("position", "turn", "role", "text", "reply_to")))
    return rows.groupBy("conv_id", F.floor(F.col("position") / part).cast("long").alias("part")).agg(said.alias("messages"))


ORACLE = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, i AS line, string_split(coalesce(text, ''), chr(10))[i] AS raw
  FROM conversations, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
l AS (
  SELECT conv_id, turn, line, raw, len(replace(regexp_extract(raw, '^((?:> ?)+)', 1), ' ', '')) AS level,
         trim(regexp_replace(lower(regexp_replace(raw, '^((?:> ?)+)', '')), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS words
  FROM raw),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY line) - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY line) AS run FROM l WHERE words <> ''),
p AS (
  SELECT DISTINCT * FROM (
    SELECT conv_id, turn, level, sha256(string_agg(words, ' ' ORDER BY line)) AS hash FROM k GROUP BY conv_id, turn, level, run
    UNION ALL SELECT conv_id, turn, level, sha256(words) FROM k WHERE level = 0)),
firsts AS (SELECT conv_id, hash, min(turn) AS origin FROM p WHERE level = 0 GROUP BY ALL),
links AS (SELECT q.*, f.origin FROM p q JOIN firsts f USING (conv_id, hash) WHERE q.level > 0 AND f.origin < q.turn),
parent AS (SELECT conv_id, turn, first(origin ORDER BY level, origin DESC) AS reply_to FROM links GROUP BY ALL),
chain AS (
  SELECT conv_id, turn, reply_to AS anchor FROM parent
  UNION SELECT c.conv_id, c.turn, p.reply_to FROM chain c JOIN parent p ON p.conv_id = c.conv_id AND p.turn = c.anchor),
ends AS (SELECT conv_id, turn, min(anchor) AS anchor FROM chain GROUP BY ALL),
counts AS (SELECT conv_id, turn, count(*) AS n_quotes, max(level) AS depth FROM p WHERE level > 0 GROUP BY ALL),
hits AS (SELECT conv_id, turn, count(*) AS n_linked FROM (SELECT DISTINCT conv_id, turn, level, hash FROM links) GROUP BY ALL),
plain AS (SELECT conv_id, turn, string_agg(raw, chr(10) ORDER BY line) FILTER (level = 0) AS text FROM l GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY reply_key, role NULLS FIRST, text) - 1 AS position FROM (
SELECT c.conv_id, c.turn, c.role, trim(coalesce(plain.text, ''), ' ') AS text, parent.reply_to, coalesce(ends.anchor, c.turn) AS anchor,
       lpad(to_hex(xor(coalesce(ends.anchor, c.turn)::BIGINT, (-9223372036854775807 - 1)::BIGINT)), 16, '0') || '.' || lpad(to_hex(xor(c.turn::BIGINT, (-9223372036854775807 - 1)::BIGINT)), 16, '0') AS reply_key,
       coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(depth, 0)::BIGINT AS depth
FROM conversations c LEFT JOIN parent USING (conv_id, turn) LEFT JOIN ends USING (conv_id, turn) LEFT JOIN counts USING (conv_id, turn)
LEFT JOIN hits USING (conv_id, turn) LEFT JOIN plain USING (conv_id, turn))
"""
