"""Queries of samples with quotas, changes between versions, and long chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import chunking, diffs, quotas, run_reports
from corvane.operators.retrieval import ranked
from corvane.plans.registry import query
from corvane.sources.tables import table

PRIORITIES = {"1-URGENT": 40, "2-HIGH": 30, "3-MEDIUM": 20, "5-LOW": 10}
STATES = {"F": 55, "O": 35, "P": 10}


@query(f"""WITH t AS (FROM (VALUES {", ".join(f"('o_orderpriority', '{k}', {n})" for k, n in PRIORITIES.items())}, {", ".join(f"('o_orderstatus', '{k}', {n})" for k, n in STATES.items())}) v(axis, value, target))
SELECT axis, value, target, target AS taken, 0 AS deficit, target AS rows FROM t""")
def two_margin_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred orders whose priorities and states both have their shares, which is what the sample has; each margin with the rows that were taken. There are orders enough in each cell
    for both margins to be met."""
    own = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    rows, report = quotas.two_margins(own, "o_orderpriority", "o_orderstatus", PRIORITIES, STATES, "o_orderkey", "m1")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("value")) for c in ("o_orderpriority", "o_orderstatus")])).alias("x")
    counts = rows.select(each).groupBy("x.axis", "x.value").agg(F.count("*").cast("int").alias("rows"))
    return report.join(counts, ["axis", "value"], "left").select("axis", "value", "target", "taken", "deficit", F.coalesce("rows", F.lit(0)).alias("rows"))


@query()
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty documents of each language, sources taking turns, no two of one length; turns depend on those before, which SQL has no form of."""
    own = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    langs = {r[0]: 20 for r in own.select("lang").distinct().limit(1000).collect() if r[0] is not None}
    return quotas.round_robin(own, "lang", "source", "n_chars", langs, "doc_id", "r2")


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), w AS (SELECT 40 * count(*) AS total FROM c),
l AS (SELECT coalesce(max(x), 0) AS level FROM (SELECT unnest(range(0, (SELECT total FROM w) + 1)) AS x) r WHERE (SELECT sum(least(n, 40 + x)) FROM c) <= (SELECT total FROM w)),
f AS (SELECT lang, n, least(n, 40 + level) AS given, n > 40 + level AS more, level FROM c, l),
t AS (SELECT lang, given + CASE WHEN more AND row_number() OVER (PARTITION BY more ORDER BY lang) <= (SELECT total FROM w) - (SELECT sum(given) FROM f) THEN 1 ELSE 0 END AS given FROM f),
o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('w5' || doc_id), doc_id) AS k FROM documents)
SELECT doc_id, lang FROM o JOIN t USING (lang) WHERE k <= given""")
def redistributed_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Forty documents of each language; what a language lacks is taken evenly from the others."""
    own = table(spark, sf, "documents").select("doc_id", "lang")
    langs = {x: 40 for x in sorted(r[0] for r in own.select("lang").distinct().limit(1000).collect() if r[0] is not None)}
    return quotas.redistributed(own, "lang", langs, "doc_id", "w5")


SNAPSHOTS = """WITH m AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS mid FROM events),
s AS (SELECT user_id, ts < mid AS early, event_type, value, props, row_number() OVER (PARTITION BY user_id, ts < mid ORDER BY ts DESC, event_id DESC) AS n FROM events, m),
a AS (SELECT user_id, event_type, CASE WHEN value >= 50 THEN value END AS value, props FROM s WHERE n = 1 AND early),
b AS (SELECT user_id, event_type, CASE WHEN value >= 50 THEN value END AS value, props FROM s WHERE n = 1 AND NOT early),
j AS (SELECT a.user_id AS ka, b.user_id AS kb, a.event_type AS ta, b.event_type AS tb, a.value AS va, b.value AS vb, a.props AS pa, b.props AS pb FROM a FULL JOIN b ON a.user_id = b.user_id),
f AS (SELECT *, unnest([CASE WHEN ta <> tb THEN 'event_type:changed' END, CASE WHEN va IS NULL AND vb IS NOT NULL THEN 'value:set' WHEN va IS NOT NULL AND vb IS NULL THEN 'value:cleared' WHEN va <> vb THEN 'value:changed' END, CASE WHEN pa <> pb THEN 'props:changed' END]) AS x FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL)"""


@query(f"""{SNAPSHOTS} SELECT NULL AS field, CASE WHEN ka IS NULL THEN 'added' WHEN kb IS NULL THEN 'removed' WHEN ta <> tb OR va IS DISTINCT FROM vb OR pa <> pb THEN 'changed' ELSE 'same' END AS how, count(*) AS n FROM j GROUP BY ALL
UNION ALL SELECT split_part(x, ':', 1), split_part(x, ':', 2), count(*) FROM f WHERE x IS NOT NULL GROUP BY ALL""")
def field_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Users' last events in the first and the second half of the time, compared by field."""
    own = table(spark, sf, "events")
    half = F.expr("(unix_micros(cast(a as timestamp)) + unix_micros(cast(b as timestamp))) div 2")
    mid = own.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.timestamp_micros(half).alias("mid"))  # one row
    own = own.crossJoin(F.broadcast(mid)).withColumn("early", F.col("ts").cast("timestamp") < F.col("mid"))
    last = ranked(own, ["user_id", "early"], F.desc("ts"), F.desc("event_id"), k=1)
    last = last.select("user_id", "early", "event_type", F.when(F.col("value") >= 50, F.col("value")).alias("value"), "props")
    return diffs.field_counts(diffs.changes(last.where("early"), last.where("not early"), "user_id", ["event_type", "value", "props"]))


@query("""WITH d AS (SELECT doc_id, lang, source, trim(split_part(text, chr(10), 1)) AS a, trim(string_split(text, chr(10))[-1]) AS b, n_chars, length(text) AS m FROM documents),
e AS (SELECT *, (a IS DISTINCT FROM b)::INT AS c, (n_chars <> m)::INT AS x FROM d),
g AS (SELECT 'lang' AS dimension, lang AS value, c FROM e UNION ALL SELECT 'lang_source', coalesce(lang, '<unknown>') || '/' || coalesce(source, '<unknown>'), c FROM e UNION ALL SELECT 'all', '', c FROM e UNION ALL SELECT 'integrity', '', x FROM e),
s AS (SELECT dimension, coalesce(value, '<unknown>') AS value, count(*) AS total, sum(c)::BIGINT AS changed FROM g GROUP BY ALL)
SELECT dimension, value, total, changed, round(changed / total::DOUBLE, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY changed DESC, total DESC, value) <= 10""")
def variant_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Two texts for a document, its first and its last line, as two exports: where they differ, by language and source, the first ten values, which is what the report has."""
    own = table(spark, sf, "documents").withColumn("lines", F.split("text", "\n"))
    old = own.select("doc_id", "lang", "source", F.trim(F.element_at("lines", 1)).alias("t"), "n_chars")
    new = own.select("doc_id", F.trim(F.element_at("lines", -1)).alias("t"), F.length("text").cast("long").alias("n_chars"))
    return diffs.broken_down(old.withColumn("n_chars", F.col("n_chars").cast("long")), new, "doc_id", "t", ["n_chars"], {"lang": ["lang"], "lang_source": ["lang", "source"]})


@query()
def chunk_long_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Long chunks of documents, whose lines are a list, ready chunks or a text by their source's last digit, and why; a chunk depends on the one before, which SQL has no form of."""
    lines = F.split("text", "\n")
    kind = F.coalesce(F.substring("source", -1, 1).try_cast("int") % 3, F.lit(2))
    none = F.lit(None)
    own = table(spark, sf, "documents").where("text is not null")
    entries = F.when(kind == 1, F.transform(lines, lambda x: F.struct(F.lit("").alias("name"), x.alias("desc"))))
    rows = own.select("doc_id", F.lit(0).alias("no"), F.coalesce("source", F.lit("")).alias("section"), F.when(kind == 0, lines).alias("chunks"), entries.alias("list"), F.when(kind == 2, F.col("text")).otherwise(none).alias("text"))
    return chunking.long_tail(chunking.diagnosed(rows, 200), (100, 200, 400))


@query("""WITH e AS (SELECT user_id % 10 AS team, event_type = 'error' AS error, event_type = 'signup' AS skipped, CASE WHEN value < 100 THEN (props::JSON->>'k')::DOUBLE / 100 END AS hit, value FROM events),
g AS (SELECT *, NOT error AND NOT skipped AS good FROM e)
SELECT team, count(*) AS row_count, count(*) FILTER (WHERE good) AS evaluated, count(*) FILTER (WHERE skipped) AS skipped, count(*) FILTER (WHERE error) AS errors, round(avg(hit) FILTER (WHERE good), 4) AS mean_hit, round(avg(value) FILTER (WHERE good), 3) AS mean_value,
  round(max(value) FILTER (WHERE good), 3) AS max_value, round(quantile_cont(value, 0.5) FILTER (WHERE good), 3) AS p50_value, round(quantile_disc(value, 0.95) FILTER (WHERE good), 3) AS p95_value FROM g GROUP BY team""")
def run_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as runs by team of users: errors fail, signups are skipped, values are times."""
    kind, k = F.col("event_type"), F.try_variant_get(F.parse_json("props"), "$.k", "int")
    own = table(spark, sf, "events").select((F.col("user_id") % 10).alias("team"), "event_type", F.when(F.col("value") < 100, k.cast("double") / 100).alias("hit"), "value")
    return run_reports.summarized(own, "team", kind == "error", kind == "signup", ["hit"], ["value"])
