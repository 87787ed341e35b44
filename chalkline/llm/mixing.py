"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. The cells' token
weights are raked to the three marginals in turn until they fit, which gives
each cell a target share of the tokens; documents are then sampled with the
probability min(1, scale * target share / present share), where the scale makes
the expected tokens of the sample equal to the budget. Everything is DataFrame
expressions. Every source has cells and a target of its own, however many there
are: a source is one row with the tokens of its languages and topics, whose factor
follows from those of the languages and topics; so a sweep is one sum over the
sources, and the driver only holds a factor for each language and topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import table, written

#: Languages without a target of their own.
OTHER = "(other)"
#: Passes over the three marginals.
SWEEPS = 25
#: Share of the tokens that the sample should hold. Cells that are short of documents are taken whole, so a larger budget moves the mix away from the targets.
BUDGET = 0.5
SEED = "mix"
#: A topic is the first whose markers a text contains.
TOPICS = [("legal", ["icense", "opyright", "ights reserved"]), ("contact", ["@", "http"]), ("table", [" | "]), ("question", ["?"])]
DEFAULT_TOPIC = "prose"
#: Target weights by language (others get OTHER_SHARE together), and the exponents that flatten the shares of sources and topics.
LANGUAGES = {"en": 0.5, "de": 0.17, "fr": 0.17, "es": 0.16}
OTHER_SHARE = 0.02
SOURCE_POWER, TOPIC_POWER = 0.5, 0.85
WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    out = F.lit(DEFAULT_TOPIC)
    for name, markers in reversed(TOPICS):
        hit = F.contains(text, F.lit(markers[0]))
        for m in markers[1:]:
            hit = hit | F.contains(text, F.lit(m))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def _uniform(doc_id: Column) -> Column:
    """A fixed number in [0, 1) for each id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def labelled(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("(none)")).alias("source"), F.coalesce(F.col("lang"), F.lit("(none)")).alias("lang"),
        topic(text).alias("topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))


def _pooled(lang: Column) -> Column:
    return F.when(lang.isin(*LANGUAGES), lang).otherwise(F.lit(OTHER))


def _rake(sums: list[float], f: list[float], kinds: list[str], targets: dict[str, float]) -> list[float]:
    """The factors f raked to the targets of kinds: the sums hold each cell's weight for factors of 1, kinds its category."""
    present = {k: sum(n * x for n, x, kind in zip(sums, f, kinds) if kind == k) for k in targets}
    return [x * targets[k] / present[k] if k in targets else x for x, k in zip(f, kinds)]


def cell_rates(docs: DataFrame, sweeps: int = SWEEPS, budget: float = BUDGET) -> DataFrame:
    """(s, l, t, probability) of each cell with tokens: source, pooled language, topic."""
    pairs = [(x, y) for x in (*LANGUAGES, OTHER) for y in (*(name for name, _ in TOPICS), DEFAULT_TOPIC)]
    langs, topics = map(list, zip(*pairs))
    held = [F.coalesce(F.sum(F.when((_pooled(F.col("lang")) == x) & (F.col("topic") == y), F.col("n_tokens"))), F.lit(0)).cast("double") for x, y in pairs]
    own = docs.where("n_tokens > 0").groupBy(F.col("source").alias("s")).agg(F.sum("n_tokens").cast("double").alias("m"), F.array(*held).alias("ns"))
    sources, _ = written(own, "mix-sources")
    ns, target = [F.col("ns")[k] for k in range(len(pairs))], F.pow("m", F.lit(SOURCE_POWER))
    first = sources.agg(F.sum(target), *[F.sum(n) for n in ns]).first()
    whole, n = first[0] or 1.0, [x or 0.0 for x in first[1:]]

    def shares(kinds: list[str], weight) -> dict[str, float]:
        total = {k: sum(x for x, kind in zip(n, kinds) if kind == k) for k in kinds}
        v = {k: weight(k, x) for k, x in total.items() if x}
        return {k: x / sum(v.values()) for k, x in v.items()}

    by_lang = shares(langs, lambda k, x: LANGUAGES.get(k, OTHER_SHARE))
    by_topic = shares(topics, lambda k, x: x**TOPIC_POWER)
    f, factor = [1.0] * len(pairs), F.lit(1.0)
    for _ in range(sweeps if any(n) else 0):
        # as one array the factors are data of the generated code, which is then the same in each sweep
        held_by = F.aggregate(F.zip_with("ns", F.lit(f), lambda n, y: n * y), F.lit(0.0), lambda a, b: a + b)
        factor = target / whole / held_by
        sums = list(sources.agg(*[F.sum(x * factor) for x in ns]).first())
        f = _rake(sums, f, langs, by_lang)
        f = _rake(sums, f, topics, by_topic)
    names = F.array(*[F.struct(F.lit(x).alias("l"), F.lit(y).alias("t"), F.lit(v).alias("f")) for (x, y), v in zip(pairs, f)])
    cell = F.explode(F.arrays_zip(names.alias("c"), F.col("ns").alias("n")))
    ratio, _ = written(sources.select("s", factor.alias("a"), cell.alias("x")).select("s", "x.c.l", "x.c.t", "x.n", (F.col("a") * F.col("x.c.f")).alias("r")).where("n > 0"), "mix-ratios")
    # the scale: cells whose probability would pass 1 are taken whole, the others share what is left of the budget, until no further cell passes 1
    scale, whole_cells = 0.0, -1
    while True:
        over = F.col("r") * F.lit(scale) > 1
        full, rest, count = ratio.agg(F.sum(F.when(over, F.col("n")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("n") * F.col("r"))), F.count_if(over)).first()
        if not rest:
            return ratio.select("s", "l", "t", F.lit(1.0).alias("probability"))
        if count == whole_cells:
            break
        scale, whole_cells = (budget * sum(n) - full) / rest, count
    return ratio.select("s", "l", "t", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(scale) * F.col("r"))).alias("probability"))


def mixed(documents: DataFrame, sweeps: int = SWEEPS, budget: float = BUDGET) -> DataFrame:
    """One row for each row of documents with its cell, tokens, probability and whether the sample holds it.

    Null sources and languages are the category "(none)". Documents without a
    word are in no cell: probability 0, not selected. Rows that repeat a doc_id
    and fall into one cell share their fate; a null doc_id is an id of its own.
    An empty table gives no rows. Other columns are not read.
    """
    docs = labelled(documents)
    rates, _ = written(cell_rates(docs, sweeps, budget), "mix-rates")
    out = docs.withColumn("s", F.col("source")).withColumn("l", _pooled(F.col("lang"))).join(rates.withColumnRenamed("t", "topic"), ["s", "l", "topic"], "left")
    p = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(0.0))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round(p, 9).alias("probability"), (_uniform(F.col("doc_id")) < p).alias("selected"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the sampled documents. The documents meet their cells' rates in one join."""
    plain = labelled(docs)
    rates, _ = written(cell_rates(plain), "mix-rates")
    text = F.coalesce("text", F.lit(""))
    lang = F.coalesce("lang", F.lit("(none)"))
    keyed = docs.withColumns({"__mix_s": F.coalesce("source", F.lit("(none)")), "__mix_l": _pooled(lang), "__mix_t": topic(text), "__mix_words": text.rlike(WORD)})
    keyed = keyed.join(rates.select(F.col("s").alias("__mix_s"), F.col("l").alias("__mix_l"), F.col("t").alias("__mix_t"), F.col("probability").alias("__mix_p")), ["__mix_s", "__mix_l", "__mix_t"], "left")
    return keyed.where(F.col("__mix_words") & (_uniform(F.col("doc_id").cast("long")) < F.coalesce("__mix_p", F.lit(0.0)))).select(*docs.columns)


def _topic_sql() -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{m}{chr(39)})' for m in markers)} THEN '{name}'" for name, markers in TOPICS) + f" ELSE '{DEFAULT_TOPIC}' END"


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, {_topic_sql()} AS topic,
         CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
e AS (SELECT d.*, source AS s, CASE WHEN lang IN ({', '.join(f"'{x}'" for x in LANGUAGES)}) THEN lang ELSE '{OTHER}' END AS l FROM d),
cells AS (SELECT s, l, topic AS t, CAST(sum(n_tokens) AS DOUBLE) AS n FROM e GROUP BY ALL HAVING sum(n_tokens) > 0),
ts AS (SELECT s, v / sum(v) OVER () AS v FROM (SELECT s, pow(sum(n), {SOURCE_POWER}) AS v FROM cells GROUP BY s)),
tl AS (SELECT l, v / sum(v) OVER () AS v FROM (SELECT DISTINCT l, CASE l {' '.join(f"WHEN '{k}' THEN {v}" for k, v in LANGUAGES.items())} ELSE {OTHER_SHARE} END::DOUBLE AS v FROM cells)),
tt AS (SELECT t, v / sum(v) OVER () AS v FROM (SELECT t, pow(sum(n), {TOPIC_POWER}) AS v FROM cells GROUP BY t)),
c0 AS (SELECT cells.*, ts.v AS vs, tl.v AS vl, tt.v AS vt FROM cells JOIN ts USING (s) JOIN tl USING (l) JOIN tt USING (t)),
ipf AS (
  SELECT 0 AS i, s, l, t, n, vs, vl, vt, n AS w FROM c0
  UNION ALL
  SELECT i + 1, s, l, t, n, vs, vl, vt, CASE i % 3 WHEN 0 THEN w * (vs / sum(w) OVER (PARTITION BY s)) WHEN 1 THEN w * (vl / sum(w) OVER (PARTITION BY l)) ELSE w * (vt / sum(w) OVER (PARTITION BY t)) END
  FROM ipf WHERE i < {3 * SWEEPS}),
ratio AS (SELECT s, l, t, n, w / n AS r FROM ipf WHERE i = {3 * SWEEPS}),
scaled AS (
  SELECT *, row_number() OVER o AS k,
         ({BUDGET} * sum(n) OVER () - coalesce(sum(n) OVER (ORDER BY r DESC, s, l, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(n * r) OVER (ORDER BY r DESC, s, l, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM ratio WINDOW o AS (ORDER BY r DESC, s, l, t)),
best AS (SELECT arg_min(scale, k) AS scale FROM scaled WHERE scale * r <= 1),
p AS (SELECT s, l, t AS topic, least(1.0, greatest(0.0, coalesce(best.scale * r, 1.0)))::DOUBLE AS probability FROM scaled, best),
f AS (SELECT e.*, CASE WHEN n_tokens > 0 THEN coalesce(probability, 0) ELSE 0 END::DOUBLE AS q FROM e LEFT JOIN p USING (s, l, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(q, 9) AS probability,
       CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT)::DOUBLE / {1 << 48} < q AS selected
FROM f
"""
