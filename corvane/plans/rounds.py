"""Queries of executed recovery rounds, resumed exports and nested result records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import emission, recovery
from corvane.operators.retrieval import ranked
from corvane.plans.evaluation import SIGNALS, verdicts
from corvane.plans.registry import query
from corvane.plans.search import FOLDED, TOKENS, neighbours
from corvane.sources import nested, resumable, scratch
from corvane.sources.tables import table

PLAIN = r"trim(regexp_replace(regexp_replace(lower(trim(coalesce({}, ''))), '[/>·]', ' ', 'g'), '\s+', ' ', 'g'))"

ROUNDS = rf"""{SIGNALS}, ti AS (SELECT doc_id, array_to_string(list_slice({TOKENS.format("text")}, 1, 3), ' ') AS title FROM documents),
ve AS (SELECT c.query_id, c.action, b.text AS query, w.title AS wanted, {PLAIN.format("w.title")} AS wk
  FROM c JOIN benchmark b ON b.item_id * 20 = c.query_id LEFT JOIN ti w ON w.doc_id = c.query_id),
ka AS (SELECT ve.query_id, h.rank, title, wk, {PLAIN.format("title")} AS k FROM ve JOIN h USING (query_id) JOIN ti USING (doc_id) WHERE rank <= 5),
ua AS (SELECT query_id, title, rank, row_number() OVER (PARTITION BY query_id, k ORDER BY rank) AS n FROM ka WHERE k <> '' AND k <> wk),
za AS (SELECT query_id, string_agg(title, ' ' ORDER BY rank) AS terms FROM ua WHERE n = 1 GROUP BY query_id),
mo AS (SELECT ve.*, terms, unnest(CASE WHEN action = 'QUERY_REWRITE' THEN ['oracle', 'production_like'] ELSE [NULL] END) AS mode FROM ve LEFT JOIN za USING (query_id)),
tr AS (
  SELECT query_id * 2 + CASE WHEN mode = 'production_like' THEN 1 ELSE 0 END AS attempt, query_id, mode,
    CASE action WHEN 'ANSWER' THEN 'NOOP' WHEN 'ANSWER_WITH_CAUTION' THEN 'SKIP_CAUTION' WHEN 'QUERY_REWRITE' THEN 'ATTEMPT_REWRITE'
      WHEN 'HYBRID_RECOVERY' THEN 'ATTEMPT_HYBRID' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'SKIP_REFUSE' ELSE 'SKIP_DEFER' END AS plan,
    coalesce(query || ' | ' || nullif(concat_ws(' ', CASE WHEN mode = 'oracle' AND wk <> '' THEN wanted END, CASE WHEN mode IS NOT NULL THEN terms END), ''), query) AS text FROM mo
),
dt AS (SELECT doc_id, {FOLDED.format("text")} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dt),
qt AS (SELECT attempt, term, count(*) AS times FROM (SELECT attempt, unnest({FOLDED.format("text")}) AS term FROM tr WHERE plan LIKE 'ATTEMPT%') GROUP BY ALL),
pt AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
ft AS (SELECT term, count(*) AS df FROM pt GROUP BY term),
ct AS (SELECT attempt, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM pt JOIN qt USING (term) JOIN ft USING (term), st GROUP BY ALL),
rt AS (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY score DESC, doc_id) AS rank FROM ct),
lt AS (SELECT attempt, doc_id, rank, 0 AS list FROM tr JOIN h USING (query_id) WHERE plan LIKE 'ATTEMPT%' UNION ALL SELECT attempt, doc_id, rank, 1 FROM rt WHERE rank <= 100),
fu AS (SELECT attempt, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min({{'list': list, 'rank': rank}}) AS first FROM lt GROUP BY ALL),
ra AS (SELECT attempt, doc_id, row_number() OVER (PARTITION BY attempt ORDER BY score DESC, first, doc_id) AS rank FROM fu),
af AS (SELECT attempt, doc_id, rank FROM ra WHERE rank <= 10 UNION ALL SELECT attempt, doc_id, rank FROM tr JOIN h USING (query_id) WHERE plan NOT LIKE 'ATTEMPT%'),
go AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
be AS (SELECT query_id, min(rank) AS before FROM h JOIN go USING (query_id, doc_id) GROUP BY query_id),
an AS (SELECT attempt, min(rank) AS after FROM af JOIN tr USING (attempt) JOIN go USING (query_id, doc_id) GROUP BY attempt),
ju AS (
  SELECT tr.*, before, after, plan NOT LIKE 'ATTEMPT%' AS skipped, CASE WHEN plan NOT LIKE 'ATTEMPT%' OR before IS NULL AND after IS NULL THEN NULL
    WHEN before IS NULL THEN -(11 - after) WHEN after IS NULL THEN 11 - before ELSE after - before END AS delta FROM tr LEFT JOIN be USING (query_id) LEFT JOIN an USING (attempt)
)"""


@query(f"""{ROUNDS} SELECT ju.query_id, ju.mode, plan, before, after, delta, skipped, NOT skipped AND before IS NULL AND after IS NOT NULL AS recovered,
  NOT skipped AND before IS NOT NULL AND after IS NULL AS regression, round(rt.score, 4) AS top_score FROM ju LEFT JOIN rt ON rt.attempt = ju.attempt AND rt.rank = 1""")
def recovery_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Doubted vector lists of passages recovered by lexical search: passage i asks with the vector 20 i, a vector stands for the document of its id, titles are a
    document's first words, and gold are the vectors of the query's label."""
    own = scratch.written(neighbours(spark, sf))
    titles = table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(T.tokens(F.col("text")), 1, 3), " ").alias("title"))
    head = own.where("rank <= 5").join(titles, "doc_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x.title).alias("titles"))
    texts = table(spark, sf, "benchmark").select((F.col("item_id") * 20).alias("query_id"), F.col("text").alias("query"))
    asked = verdicts(spark, sf).select("query_id", "action").join(texts, "query_id").join(head, "query_id", "left").join(titles.select(F.col("doc_id").alias("query_id"), F.col("title").alias("wanted")), "query_id", "left")
    asked = asked.withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    vectors = table(spark, sf, "embeddings").select("vec_id", "label")
    gold = own.where("gold").select("query_id", "doc_id")
    first = asked.select("query_id")
    gold = gold.unionByName(_other_gold(vectors, first)).distinct()
    out = recovery.run(asked, own, table(spark, sf, "documents"), gold)
    return out.select("query_id", "mode", "plan", "before", "after", "delta", "skipped", "recovered", "regression", F.round("top_score", 4).alias("top_score"))


def _other_gold(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id of all vectors with a query's label; a label has as many rows as vectors, queries are few."""
    own = queries.join(vectors, F.col("vec_id") == F.col("query_id")).select("query_id", "label")
    return own.join(vectors, "label").where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("doc_id"))


@query("SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars, md5(coalesce(text, '')) AS digest FROM documents WHERE doc_id IS NOT NULL")
def resumed_export(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' digests exported as JSON lines by a run that stops after three of eight slices, and one that resumes it."""
    path = f"{scratch.folder(spark)}/export-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select("doc_id", "text")

    def make(some: DataFrame) -> DataFrame:
        return some.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))

    resumable.append(rows, path, "doc_id", make, upto=3)
    resumable.append(rows, path, "doc_id", make)
    return resumable.committed(spark, path, "doc_id long, n_chars long, digest string")


ADAPTED = r"""WITH f AS (SELECT user_id, event_id, event_type, (props::JSON->>'k')::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events),
t AS (SELECT * FROM f WHERE rank <= 5),
g AS (SELECT 'p' || page_id AS chunk_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts, url FROM pages),
c AS (SELECT chunk_id, parts[1] AS page_title, array_to_string(list_filter(parts, lambda x: x <> ''), ' > ') AS path FROM g)
SELECT 'u' || user_id AS query_id, CASE WHEN user_id % 7 <> 0 THEN t.rank END AS rank, CASE WHEN user_id % 7 <> 0 THEN 'p' || k END AS chunk_id,
  CASE WHEN user_id % 7 <> 0 THEN coalesce(c.page_title, event_type) END AS page_title,
  CASE WHEN user_id % 7 = 0 THEN NULL WHEN c.path IS NOT NULL THEN c.path WHEN k % 3 = 0 THEN event_type || ' > ' || k WHEN k % 3 = 1 THEN event_type ELSE k::VARCHAR END AS section_path,
  CASE WHEN user_id % 7 = 0 THEN 'docs not a list' WHEN c.chunk_id IS NULL THEN 'missing chunk' WHEN c.page_title <> event_type THEN 'mismatch: page_title,section_path' END AS problem
FROM t LEFT JOIN c ON c.chunk_id = 'p' || k WHERE user_id % 7 <> 0 OR t.rank = 1"""


@query(ADAPTED)
def adapted_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of users' latest events as nested results, whose paths are lists, texts or numbers by the event's own property, beside pages as chunks; every seventh user's record has no list."""
    k = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    own = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts", k.alias("k"))
    own = ranked(own, "user_id", F.desc("ts"), "event_id", k=5)
    kind, number = F.col("event_type"), F.col("k").cast("string")
    path = F.when(F.col("k") % 3 == 0, F.concat(F.lit('["'), kind, F.lit('","",'), number, F.lit("]"))).when(F.col("k") % 3 == 1, F.concat(F.lit('"'), kind, F.lit('"'))).otherwise(number)
    doc = F.concat(F.lit('{"rank":'), F.col("rank").cast("string"), F.lit(',"chunk_id":"p'), number, F.lit('","title":"'), kind, F.lit('","section_path":'), path, F.lit("}"))
    docs = F.concat(F.lit("["), F.array_join(F.collect_list(doc), ","), F.lit("]"))
    docs = own.groupBy("user_id").agg(docs.alias("docs"))
    body = F.when(F.col("user_id") % 7 == 0, F.lit('"none"')).otherwise(F.col("docs"))
    lines = docs.select(F.concat(F.lit('{"query_id":"u'), F.col("user_id").cast("string"), F.lit('","docs":'), body, F.lit("}")).alias("value"))
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    chunks = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("chunk_id"), F.lit("").alias("page_id"), parts[0].alias("page_title"), F.lit("").alias("section_id"), F.array_join(F.filter(parts, lambda x: x != ""), nested.JOINER).alias("section_path"), F.lit("").alias("chunk_text"))
    gold = lines.sparkSession.createDataFrame([], "query_id string, page_id string, section_path string")
    return nested.adapted(lines, chunks, gold).select("query_id", "rank", "chunk_id", "page_title", "section_path", "problem")


@query()
def emitted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations' turns as sections, exported as chunks by a run that stops after two of six slices and one that resumes it; chunks depend on those before, which SQL has no form of."""
    own = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("section"), "role", "text")
    none = F.lit(None)
    sections = own.select("doc_id", "section", none.cast("array<string>").alias("chunks"), F.array(F.struct(F.col("role").alias("name"), F.col("text").alias("desc"))).alias("list"), none.cast("string").alias("text"))
    titles = own.where("section = 'turn 0'").select("doc_id", F.array_join(F.slice(T.tokens(F.col("text")), 1, 4), " ").alias("title"), F.lit("").alias("retrieval_title"), F.col("role").alias("kind"))
    path = f"{scratch.folder(spark)}/chunks-{uuid.uuid4().hex}"
    emission.emitted(sections, titles, path, "title_section", slices=6, upto=2)
    emission.emitted(sections, titles, path, "title_section", slices=6)
    return resumable.committed(spark, path, "doc_id long, section string, chunk int, chunk_id string, tokens int, digest string")
