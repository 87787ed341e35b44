"""Quotation linking: conversations in reply order, without quotes.

A line that begins with ">" is quoted; the number of ">" is its level, up to
LEVELS. Neighbouring lines of one level are a passage, which is normalised and
hashed as a whole, and joined to the latest earlier message of its conversation
that says it: as its whole text, a paragraph or a line of its own. The lines of
a passage that no message says as a whole are looked up one by one. A message
replies to the message that most words of its quotes of the lowest level come
from, or else to the message before it. Everything is DataFrame expressions.

A conversation may hold a third of all rows. So messages are numbered, and
quotes looked up, in blocks of TURNS turns, with one row for each block carried
from block to block; no conversation is gathered in one task or one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .storage import table

#: Turns of a block; and levels of quotes that are told apart, deeper ones count as the last.
TURNS, LEVELS = 1000, 6
NO_PARENT = -1
_MARKS = r"^((?:[ \t]*>)+)"
_ATTRIBUTION = r"(?:wrote|writes|schrieb|escribió|a écrit) ?:[ \t]*$"


def _norm(line: Column) -> Column:
    """Words of the line without its quote marks: lower case, anything else one blank."""
    body = F.lower(F.regexp_replace(line, _MARKS, ""))
    return F.trim(F.regexp_replace(body, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _own(lines: Column) -> Column:
    """Lines that are neither quoted nor the attribution of the quote that follows."""
    following = lambda i: F.coalesce(F.get(lines, i + 1), F.lit(""))
    return F.filter(lines, lambda x, i: ~x.rlike(_MARKS) & ~(x.rlike(_ATTRIBUTION) & following(i).rlike(_MARKS)))


def _norm_text(text: Column) -> Column:
    """The same for several lines: one blank between them."""
    body = F.lower(F.regexp_replace(text, "(?m)" + _MARKS, ""))
    return F.trim(F.regexp_replace(body, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _passage(level: int) -> str:
    """The pattern of neighbouring lines of this level (of LEVELS: or deeper), for RE2; the JVM takes it with a possessive end."""
    rest = r"[ \t]*(?:[^ \t>\n][^\n]*)?" if level < LEVELS else r"[^\n]*"
    return rf"(?m)(?:^(?:[ \t]*>){{{level}}}{rest}(?:\n|$))+"


def _said(split: DataFrame) -> DataFrame:
    """(conv_id, turn, norm) of what messages say themselves: their whole text, paragraphs and lines."""
    own = _own(F.col("lines"))
    text = F.array_join(own, "\n")
    units = F.flatten(F.array(F.array(_norm_text(text)), F.transform(F.split(text, r"\n[ \t]*\n"), _norm_text), F.transform(own, _norm)))
    return split.select("conv_id", "turn", F.explode(F.array_distinct(units)).alias("norm")).where("norm <> ''")


def _quoted(known: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, hash, times, n_words): a row for each different passage, whose hash is that of its whole text, and one for each of its lines."""
    def of(k: int) -> Column:
        bodies = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_passage(k) + "+"), F.lit(0))
        return F.transform(bodies, lambda x: F.struct(F.lit(k).alias("level"), x.alias("body")))

    found = F.flatten(F.array(*[of(k) for k in range(1, LEVELS + 1)]))
    p = known.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", F.explode(found).alias("p")).select("conv_id", "turn", "p.level", "p.body", F.md5(_norm_text(F.col("p.body"))).alias("passage"))
    lines = F.filter(F.transform(F.split(F.regexp_replace("body", "\n$", ""), "\n"), _norm), lambda x: x != "")
    p = p.withColumn("units", F.array_union(F.array(_norm_text(F.col("body"))), lines)).select("conv_id", "turn", "level", "passage", F.explode("units").alias("norm")).where("norm <> ''")
    return p.groupBy("conv_id", "turn", "level", "passage", F.md5("norm").alias("hash")).agg(F.count(F.lit(1)).alias("times"), F.first(F.size(F.split("norm", " "))).cast("long").alias("n_words"))


def linked(conversations: DataFrame) -> DataFrame:
    """One row for each row of conversations: seq (place in the reply order, from 0), parent_turn, the number of quoted lines, the words of quotes whose origin was found, and the text without quotes.

    Messages are ordered by turn, then role and text; a message's parent always
    has a smaller turn, so the order puts replies behind what they answer. The
    first turn has the parent NO_PARENT. Rows of one conversation and turn are one message
    for links and rows of their own in the result. Null texts are empty; rows
    without conv_id or turn are kept with null seq and no parent. Other columns
    are not read; an empty table gives no rows.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("block", F.floor(F.col("turn") / TURNS))
    known = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")

    quoted = _quoted(known)
    own = _said(known.select("conv_id", "turn", _lines().alias("lines"))).select("conv_id", F.md5("norm").alias("hash"), "turn").join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()

    # the latest earlier turn that says it: within the block, or else the last one of an earlier block
    both = own.select("conv_id", "hash", "turn", F.col("turn").alias("source"), *[F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("passage", "string"), ("times", "long"), ("n_words", "long"))]).unionByName(
        quoted.withColumn("source", F.lit(None).cast("long"))).withColumn("block", F.floor(F.col("turn") / TURNS))
    inside = Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.max("source").over(inside)).where("times IS NOT NULL")
    ends = own.groupBy("conv_id", "hash", F.floor(F.col("turn") / TURNS).alias("block")).agg(F.max("turn").alias("end")).unionByName(
        quoted.select("conv_id", "hash", F.floor(F.col("turn") / TURNS).alias("block"), F.lit(None).cast("long").alias("end")))
    ends = ends.groupBy("conv_id", "hash", "block").agg(F.max("end").alias("end")).withColumn("far", F.max("end").over(Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    links = found.join(ends.select("conv_id", "hash", "block", "far"), ["conv_id", "hash", "block"]).select("conv_id", "turn", "level", "passage", "hash", "times", "n_words", F.coalesce("near", "far").alias("source")).where("source IS NOT NULL")

    # a passage that is said as a whole counts as such, else its lines do
    whole = links.groupBy("conv_id", "turn", "level", "passage").agg(F.max(F.col("hash") == F.col("passage")).alias("whole"), F.collect_set(F.struct("hash", "source", (F.col("times") * F.col("n_words")).alias("n_words"))).alias("l"))
    counted = whole.select("conv_id", "turn", "level", "passage", F.explode(F.filter("l", lambda x: ~F.col("whole") | (x["hash"] == F.col("passage")))).alias("x"))
    votes = counted.groupBy("conv_id", "turn", "level", F.col("x.source").alias("source")).agg(F.sum("x.n_words").alias("votes"))
    parent = votes.groupBy("conv_id", "turn").agg(F.min(F.struct(F.col("level"), (-F.col("votes")).alias("v"), (-F.col("source")).alias("s"))).alias("best"), F.sum("votes").alias("n_linked")).select("conv_id", "turn", (-F.col("best.s")).alias("quoted_turn"), "n_linked")

    # the turn before, and the place in the order: within the block, plus what earlier blocks end with
    blocks = known.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("end"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.max("end").over(earlier).alias("end"))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    previous = F.max("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    placed = known.withColumns({"place": F.row_number().over(order), "previous": previous}).join(blocks, ["conv_id", "block"]).join(parent, ["conv_id", "turn"], "left")
    text = F.trim(F.array_join(_own(_lines()), "\n"))
    quotes = F.size(F.filter(_lines(), lambda x: x.rlike(_MARKS))).cast("long")
    out = placed.select("conv_id", "turn", "role", (F.col("before") + F.col("place") - 1).alias("seq"), F.coalesce("quoted_turn", "previous", "end", F.lit(NO_PARENT)).cast("long").alias("parent_turn"),
                        quotes.alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), text.alias("text"))
    loose = rows.where("conv_id IS NULL OR turn IS NULL").select("conv_id", "turn", "role", F.lit(None).cast("long").alias("seq"), F.lit(NO_PARENT).cast("long").alias("parent_turn"), quotes.alias("n_quoted"), F.lit(0).cast("long").alias("n_linked"), text.alias("text"))
    return out.unionByName(loose)


def threads(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, messages): conversations without quotes, TURNS messages a row; messages are (seq, turn, parent_turn, role, text) in reply order."""
    m = linked(conversations).where("seq IS NOT NULL")
    return m.groupBy("conv_id", F.floor(F.col("seq") / TURNS).alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "turn", "parent_turn", "role", "text"))).alias("messages"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))


def _inlined(sql: str) -> str:
    """The SQL with the normal forms, and a SELECT for the passages of each level, in place of their names."""
    words = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    passages = " UNION ALL ".join(f"SELECT conv_id, turn, {k} AS level, unnest(regexp_extract_all(t, '{_passage(k)}')) AS body FROM k" for k in range(1, LEVELS + 1))
    sql = sql.replace("PASSAGES", passages)
    for name, flag in (("NORM_TEXT", "(?m)"), ("NORM_LINE", "")):
        while name in sql:
            at = sql.index(name)
            end, depth = at + len(name), 0
            while True:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
                if not depth:
                    break
            inner = sql[at + len(name) + 1 : end - 1]
            sql = sql[:at] + f"trim(regexp_replace(lower(regexp_replace({inner}, '{flag}{_MARKS}', '', 'g')), '{words}', ' ', 'g'), ' ')" + sql[end:]
    return sql


SQL = _inlined(r"""
WITH m AS (SELECT conv_id, turn, role, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
k AS (SELECT conv_id, turn, coalesce(text, '') AS t, list_filter(lines, lambda l, i: NOT regexp_matches(l, '^((?:[ \t]*>)+)') AND NOT (regexp_matches(l, '(?:wrote|writes|schrieb|escribió|a écrit) ?:[ \t]*$') AND regexp_matches(coalesce(lines[i + 1], ''), '^((?:[ \t]*>)+)'))) AS own FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
said AS (SELECT DISTINCT conv_id, turn, norm FROM (SELECT conv_id, turn, unnest(list_concat([NORM_TEXT(array_to_string(own, chr(10)))], list_transform(regexp_split_to_array(array_to_string(own, chr(10)), '\n[ \t]*\n'), lambda x: NORM_TEXT(x)), list_transform(own, lambda x: NORM_LINE(x)))) AS norm FROM k) WHERE norm <> ''),
p AS (PASSAGES),
q AS (SELECT conv_id, turn, level, NORM_TEXT(body) AS passage, list_distinct(list_concat([NORM_TEXT(body)], list_filter(list_transform(string_split(regexp_replace(body, '\n$', ''), chr(10)), lambda x: NORM_LINE(x)), lambda x: x <> ''))) AS units FROM p),
quoted AS (SELECT conv_id, turn, level, passage, norm, count(*) AS times, any_value(len(string_split(norm, ' '))) AS n_words FROM (SELECT conv_id, turn, level, passage, unnest(units) AS norm FROM q) WHERE norm <> '' GROUP BY ALL),
links AS (SELECT quoted.conv_id, quoted.turn, level, passage, quoted.norm, any_value(times * n_words) AS n_words, max(said.turn) AS source
          FROM quoted JOIN said ON said.conv_id = quoted.conv_id AND said.norm = quoted.norm AND said.turn < quoted.turn GROUP BY quoted.conv_id, quoted.turn, level, passage, quoted.norm),
counted AS (SELECT *, max(norm = passage) OVER (PARTITION BY conv_id, turn, level, passage) AS whole FROM links),
votes AS (SELECT conv_id, turn, level, source, sum(n_words) AS votes FROM counted WHERE NOT whole OR norm = passage GROUP BY ALL),
parent AS (SELECT conv_id, turn, first(source ORDER BY level, votes DESC, source DESC) AS quoted_turn, sum(votes) AS n_linked FROM votes GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role,
       CASE WHEN m.conv_id IS NOT NULL AND m.turn IS NOT NULL THEN row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn, m.role, m.text) - 1 END AS seq,
       coalesce(quoted_turn, CASE WHEN m.conv_id IS NOT NULL AND m.turn IS NOT NULL THEN max(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, -1) AS parent_turn,
       CAST(len(list_filter(lines, lambda l: regexp_matches(l, '^((?:[ \t]*>)+)'))) AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
       trim(array_to_string(list_filter(lines, lambda l, i: NOT regexp_matches(l, '^((?:[ \t]*>)+)') AND NOT (regexp_matches(l, '(?:wrote|writes|schrieb|escribió|a écrit) ?:[ \t]*$') AND regexp_matches(coalesce(lines[i + 1], ''), '^((?:[ \t]*>)+)'))), chr(10)), ' ') AS text
FROM m LEFT JOIN parent ON parent.conv_id = m.conv_id AND parent.turn = m.turn
""")
