"""Queries that rewrite formulas and repair replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import latex, replies, rules, speech, text as t
from ..sources.relations import table

#: Documents with a formula beside their text, so that every rule has something to do.
_FORMULAS = [r"\(f(x) = 3x^2 + 1\)", r"\[\frac{a}{b} \leq x^{-1}\]", r"\lim_{x \to 0} \sin x", r"\int_{0}^{1} x_i + \sum^{n} 2k", "1/2 of 0.24 and 11/2", "x^2^3 - 5a → ŷ", "arcsin(x) ≥ y_hat"]
_CASE = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FORMULAS)) + " END"
_TEXT = rf"d AS (SELECT doc_id, {_CASE} || ' ' || text AS t FROM documents)"


def _texts(spark, sf_dir):
    f = F.lit(_FORMULAS[-1])
    for i, x in enumerate(_FORMULAS[:-1]):
        f = F.when(F.col("doc_id") % 7 == i, F.lit(x)).otherwise(f)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(f, F.lit(" "), F.col("text")).alias("t"))


@query(f"WITH {_TEXT} SELECT doc_id, {latex.latex_to_text_sql('t')} AS plain FROM d")
def latex_to_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", latex.latex_to_text(F.col("t")).alias("plain"))


def _rewritten(name: str, chain) -> None:
    def run(spark, sf_dir):
        return _texts(spark, sf_dir).select("doc_id", rules.column(chain, F.col("t")).alias("speech"))

    run.__name__ = name
    query(f"WITH {_TEXT} SELECT doc_id, {rules.sql(chain, 't')} AS speech FROM d")(run)


for _name, _chain in (
    ("math_symbols", speech.SYMBOL_RULES), ("decimal_to_speech", speech.DECIMAL_RULES), ("exponent_to_speech", speech.EXPONENT_RULES), ("coefficient_to_speech", speech.COEFFICIENT_RULES),
    ("fraction_to_speech", speech.FRACTION_RULES), ("function_to_speech", speech.FUNCTION_RULES), ("subscript_to_speech", speech.SUBSCRIPT_RULES), ("hats_and_arrows_to_speech", speech.HAT_RULES + speech.ARROW_RULES), ("math_to_speech", speech.SPEECH_RULES),
):
    _rewritten(_name, _chain)


_OPENINGS = ["Then f of x equals two. ", "Here x equals 3 squared. This is a line. ", "We use the function. ", ""]
_BOARDS = ["f(x) = 3x^2 + 1", "FUNCTIONS", "", "```\ny = x_1 over 2 and more\n```", "lorem"]


def _pick(values, by):
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(F.col("doc_id") % len(values) == i, F.lit(v)).otherwise(out)
    return out.alias(by)


def _pick_sql(values, by):
    quoted = [v.replace("'", "''") for v in values]
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted)) + f" END AS {by}"


def _speech(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", _pick(_OPENINGS, "opening"), _pick(_BOARDS, "board"))
    return d.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "  ").when(F.col("doc_id") % 7 == 0, F.rtrim("opening")).otherwise(F.concat("opening", "text")).alias("text"), "board")


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SPEECH_SQL = f"""p AS (SELECT doc_id, text, {_pick_sql(_OPENINGS, 'opening')}, {_pick_sql(_BOARDS, 'board')} FROM documents),
d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 7 = 0 THEN rtrim(opening) ELSE opening || text END AS s, board FROM p)"""


def _merge_sql(source: str, speech_: str, board: str, out: str) -> str:
    """CTEs from source (key columns and speech_, board) to `merged` with the column out."""
    return rf"""m1 AS (SELECT *, {speech_} AS _s, {board} AS _raw, {_STRIP.format(board)} AS _stripped FROM {source}),
m2 AS (SELECT *, {_STRIP.format(r"CASE WHEN starts_with(_stripped, '```') AND ends_with(_stripped, '```') THEN regexp_replace(_stripped, '^[` \n]+|[` \n]+$', '', 'g') ELSE _stripped END")} AS _b FROM m1),
m3 AS (SELECT *, {rules.sql(speech.SPEECH_RULES, '_b')} AS _spoken, list_filter(list_transform(string_split(_s, '.'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS _all, lower(_s) AS _low FROM m2),
m4 AS (SELECT *, _all[1] AS _first, _all[2:] AS _rest, string_split(lower(_all[1]), ' equals ') AS _parts, string_split(lower(_spoken), ' equals ') AS _told FROM m3),
m5 AS (SELECT *, substr(_first, 1, strpos(lower(_first), ' equals ') + 7) || {_STRIP.format('_told[2]')} AS _formula FROM m4),
merged AS (SELECT *, CASE
  WHEN _b <> '' AND contains(_low, lower(_b)) THEN _s
  WHEN length(_b) < 20 AND NOT regexp_matches(_b, '[=+*/^-]') THEN CASE WHEN _first IS NULL OR _b = '' THEN _s ELSE _first || '. We''re focusing on ' || lower(_b) || '.' || CASE WHEN len(_rest) > 0 THEN ' ' || array_to_string(_rest, ' ') ELSE '' END END
  WHEN (contains(_low, 'f(x)') OR contains(_low, 'f of x') OR (contains(_low, 'equals') AND regexp_matches(_s, '[0-9²³¹⁰⁴-⁹]')) OR regexp_matches(_low, 'squared|cubed|power')) AND len(_all) >= 2 AND len(_parts) = 2 AND len(_told) = 2
  THEN CASE WHEN starts_with(lower(_rest[1]), 'this is') THEN _formula || ', which represents ' || {_STRIP.format('substr(_rest[1], 8)')} || CASE WHEN len(_rest) > 1 THEN '. ' || array_to_string(_rest[2:], '. ') ELSE '' END
       ELSE _formula || '. ' || array_to_string(_rest, ' ') || '.' END
  WHEN NOT contains(_raw, '=') OR _first IS NULL THEN _s
  ELSE _first || CASE WHEN regexp_matches(lower(_first), '(?:function|equation|formula|expression)$') AND len(_rest) = 0 THEN ', ' ELSE ', that is, ' END || _spoken || '.' || CASE WHEN len(_rest) > 0 THEN ' ' || array_to_string(_rest, '. ') || '.' ELSE '' END
  END AS {out} FROM m5)"""


@query(f"WITH {_SPEECH_SQL}, {_merge_sql('d', 's', 'board', 'fused')} SELECT doc_id, fused FROM merged")
def merge_speech_board(spark, sf_dir):
    """Documents as speech, merged with boards of every kind."""
    return speech.merged(_speech(spark, sf_dir), "text", "board", "fused").select("doc_id", "fused")


@query(f"""WITH {_SPEECH_SQL}, q AS (SELECT doc_id, {_STRIP.format('s')} AS ss, {_STRIP.format("CASE WHEN doc_id % 2 = 0 AND trim(board) <> '' THEN board ELSE CASE WHEN doc_id % 3 = 0 THEN 'z = 1' ELSE '' END END")} AS bb FROM d),
{_merge_sql('q', 'ss', 'bb', 'woven')} SELECT doc_id, CASE WHEN bb = '' THEN ss WHEN ss = '' THEN {rules.sql(speech.SPEECH_RULES, 'bb')} ELSE woven END AS tts FROM merged""")
def tts_text(spark, sf_dir):
    """The text to speak: markdown is preferred to the plain board, and one side alone stands for itself."""
    d = _speech(spark, sf_dir).withColumns({"markdown": F.when(F.col("doc_id") % 2 == 0, F.col("board")).otherwise(""), "board": F.when(F.col("doc_id") % 3 == 0, "z = 1").otherwise("")})
    return speech.tts_text(d, "text", "board", "markdown", "tts").select("doc_id", "tts")


@query(f"""WITH {_SPEECH_SQL}, q AS (SELECT doc_id, {_STRIP.format('s')} AS ss, {_STRIP.format('board')} AS bb, board FROM d)
SELECT doc_id, CASE WHEN ss = '' AND bb = '' THEN '' WHEN bb = '' THEN ss WHEN ss = '' THEN 'On the board: ' || bb WHEN contains(lower(ss), lower(board)) OR length(board) < 5 THEN ss ELSE ss || ' On the board, the equation is ' || bb || '.' END AS explanation FROM q""")
def board_explanation(spark, sf_dir):
    d = _speech(spark, sf_dir)
    return d.select("doc_id", speech.explanation(F.col("text"), F.col("board"), F.lit("")).alias("explanation"))


@query(f"""WITH {_SPEECH_SQL} SELECT doc_id, contains(lower(s), lower(board)) AS held, length(board) < 20 AND NOT regexp_matches(board, '[=+*/^-]') AS label,
  contains(lower(s), 'f(x)') OR contains(lower(s), 'f of x') OR (contains(lower(s), 'equals') AND regexp_matches(s, '[0-9²³¹⁰⁴-⁹]')) OR regexp_matches(lower(s), 'squared|cubed|power') AS told FROM d""")
def board_predicates(spark, sf_dir):
    """Whether the speech holds the board, the board is a label, and the speech tells a formula."""
    return _speech(spark, sf_dir).select("doc_id", t.mentions(F.col("text"), F.col("board")).alias("held"), t.is_label(F.col("board")).alias("label"), speech.tells_formula(F.col("text")).alias("told"))


@query(f"""WITH {_TEXT}, q AS (SELECT doc_id, '```' || chr(8203) || t || ' ```' AS original FROM d) SELECT doc_id, replace({_STRIP.format("replace(original, chr(8203), ' ')")}, '```', '') AS recognised FROM q""")
def recognised_clean(spark, sf_dir):
    d = _texts(spark, sf_dir).select("doc_id", F.concat(F.lit("```\u200b"), "t", F.lit(" ```")).alias("original"))
    return d.select("doc_id", t.clean_recognised(F.col("original")).alias("recognised"))


@query(f"WITH {_TEXT} SELECT doc_id, t AS original, {latex.latex_to_text_sql('t')} AS plain FROM d")
def recognised_with_words(spark, sf_dir):
    """Recognised texts beside their words."""
    return latex.with_words(_texts(spark, sf_dir), "t", "original", "plain").select("doc_id", "original", "plain")


_SHAPES = ['[{"id": 0, "fused": "a \\\\alpha"}, 7, {"id": 1, "text": "b"}]', '{"results": [{"fused": "a + b"}, {"sentence": "c"}]}', '{"id": 3, "fused": "x"}', '{"n": 1, "empty": [], "other": [{"id": 1}, {"content": "z"}], "later": [{"id": 9, "fused": "no"}]}', "not json", '{"items": [{"id": "2", "result": "r"}], "segments": [{"id": 4, "fused": "s"}]}', '{"text": "whole"}']
_SHAPED = "CASE conv_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SHAPES)) + " END"


@query(rf"""WITH r AS (SELECT conv_id AS run_id, turn AS batch_id, {_SHAPED} AS content FROM conversations),
j AS (SELECT run_id, batch_id, CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS j FROM r),
n AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN list_filter(['results', 'fused_segments', 'segments', 'items'], lambda k: json_type(j, '$.' || k) = 'ARRAY')[1] END AS named, CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) END AS ks FROM j),
l AS (SELECT run_id, batch_id, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) WHEN named IS NOT NULL THEN CAST(json_extract(j, '$.' || named) AS JSON[]) WHEN list_contains(ks, 'id') AND list_contains(ks, 'fused') THEN [j]
       WHEN len(list_filter(ks, lambda k: json_type(j, '$.' || k) = 'ARRAY' AND json_array_length(j, '$.' || k) > 0)) > 0 THEN CAST(json_extract(j, '$.' || list_filter(ks, lambda k: json_type(j, '$.' || k) = 'ARRAY' AND json_array_length(j, '$.' || k) > 0)[1]) AS JSON[]) WHEN j IS NOT NULL THEN [j] END AS items FROM n),
x AS (SELECT run_id, batch_id, unnest(items) AS item, unnest(range(0, len(items))) AS pos FROM l WHERE items IS NOT NULL),
y AS (SELECT *, list_filter(['fused', 'text', 'sentence', 'content', 'result'], lambda k: list_contains(json_keys(item), k))[1] AS k FROM x WHERE json_type(item) = 'OBJECT'),
z AS (SELECT run_id, batch_id, CAST(pos AS INTEGER) AS pos, coalesce(CAST(json_extract_string(item, '$.id') AS BIGINT), batch_id * 4 + pos) AS id, json_extract_string(item, '$.' || k) AS f, CASE WHEN k IS NULL THEN 'no text' END AS error FROM y
      UNION ALL SELECT run_id, batch_id, 0, NULL, NULL, 'unreadable reply' FROM l WHERE items IS NULL)
SELECT run_id, batch_id, pos, id, {latex.latex_to_text_sql('f')} AS fused, error FROM z""")
def reply_repair(spark, sf_dir):
    """Replies of every shape, repaired to one row for each item."""
    content = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("conv_id") % len(_SHAPES) + 1).cast("int"))
    r = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").cast("long").alias("batch_id"), content.alias("content"))
    return replies.repaired(r)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'said' ELSE '[Error: no text for segment ' || CASE WHEN event_id % 3 = 1 THEN CAST(event_id AS VARCHAR) ELSE '?' END || ']' END AS shown FROM events")
def shown_errors(spark, sf_dir):
    n = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select("event_id", replies.shown(F.lit("said"), F.when(n != 0, "no text"), F.when(n == 1, F.col("event_id"))).alias("shown"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def reply_key(spark, sf_dir):
    """A number out of a JSON text."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT doc_id, array_to_string(CASE WHEN len(l) = 0 THEN ['English'] ELSE l END, '|') AS languages
FROM (SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN doc_id % 3 = 0 THEN ' , ' ELSE lang || ' ,' || source || ',' END, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)""")
def language_list(spark, sf_dir):
    asked = F.when(F.col("doc_id") % 3 == 0, F.lit(" , ")).otherwise(F.concat("lang", F.lit(" ,"), "source", F.lit(",")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(t.languages(asked), "|").alias("languages"))
