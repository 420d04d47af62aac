"""Queries of text functions: overlap, leakage, noise, chunks and built texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import match as M
from corvane.functions import noise
from corvane.functions import text as T
from corvane.operators import chunking, decisions, quantiles
from corvane.plans.registry import query
from corvane.plans.search import TOKENS, passages
from corvane.sources.tables import table

NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def shingles(tokens: F.Column, n: int) -> F.Column:
    """Distinct runs of n tokens."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


OVERLAP = rf"""WITH d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(t) - 6, 1)), lambda i: array_to_string(list_slice(t, i, i + 7), ' ')))) AS g FROM (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents)),
q AS (SELECT item_id, len(g) AS n, unnest(g) AS g FROM (SELECT item_id, list_distinct(list_transform(range(1, greatest(len(t) - 6, 1)), lambda i: array_to_string(list_slice(t, i, i + 7), ' '))) AS g FROM (SELECT item_id, {TOKENS.format("text")} AS t FROM benchmark))),
c AS (SELECT item_id, doc_id, count(*) / any_value(n)::DOUBLE AS share FROM q JOIN d USING (g) GROUP BY item_id, doc_id)"""


def shared(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, doc_id, share: the share of an item's runs of 8 tokens that a document has. Runs that no item has stop at the scan's side of the join."""
    # A lambda that holds the tokens' expression would evaluate it anew for each run, so the tokens are a generated row's column first.
    held = lambda c: F.explode(F.array(T.tokens(F.col(c)))).alias("t")
    own = documents(spark, sf).select("doc_id", held("text")).select("doc_id", F.explode(shingles(F.col("t"), 8)).alias("g"))
    items = passages(spark, sf).select(F.col("query_id").alias("item_id"), held("text")).select("item_id", shingles(F.col("t"), 8).alias("all"))
    items = items.select("item_id", F.size("all").alias("n"), F.explode("all").alias("g"))
    return own.join(items, "g").groupBy("item_id", "doc_id").agg((F.count("*") / F.first("n")).alias("share"))


@query(f"{OVERLAP} SELECT item_id, doc_id, round(share, 6) AS share FROM c")
def ngram_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf).select("item_id", "doc_id", F.round("share", 6).alias("share"))


@query(f"""{OVERLAP}, m AS (SELECT item_id, max(share) AS best, count(*) AS n FROM c GROUP BY item_id) SELECT b.item_id, round(coalesce(best, 0), 6) AS containment, coalesce(n, 0) AS n_docs, CASE WHEN best >= 0.35 THEN 'high' WHEN best >= 0.20 THEN 'medium' ELSE 'low' END AS risk FROM benchmark b LEFT JOIN m USING (item_id)""")
def overlap_risk(spark: SparkSession, sf: str) -> DataFrame:
    best = shared(spark, sf).groupBy("item_id").agg(F.max("share").alias("best"), F.count("*").alias("n"))
    own = table(spark, sf, "benchmark").select("item_id").join(best, "item_id", "left")
    chunk = F.coalesce("best", F.lit(0.0))
    return own.select("item_id", F.round(chunk, 6).alias("containment"), F.coalesce("n", F.lit(0)).alias("n_docs"), decisions.overlap_risk(F.lit(None).cast("double"), chunk, F.lit(None).cast("int")).alias("risk"))


@query(f"""{OVERLAP}, r AS (SELECT item_id, doc_id, CASE WHEN share >= 0.35 THEN 'high' WHEN share >= 0.20 THEN 'medium' ELSE 'low' END AS risk FROM c)
SELECT lang, count(*) FILTER (WHERE risk = 'low') AS low, count(*) FILTER (WHERE risk = 'medium') AS medium, count(*) FILTER (WHERE risk = 'high') AS high FROM r JOIN documents USING (doc_id) GROUP BY lang""")
def leakage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    risk = decisions.overlap_risk(F.lit(None).cast("double"), F.col("share"), F.lit(None).cast("int"))
    own = shared(spark, sf).withColumn("risk", risk).join(documents(spark, sf).select("doc_id", "lang"), "doc_id")
    return own.groupBy("lang").agg(*[F.count_if(F.col("risk") == x).alias(x) for x in ("low", "medium", "high")])


@query(rf"""WITH n AS (SELECT item_id, {NORMAL.format("text")} AS t FROM benchmark), g AS (SELECT item_id, CASE WHEN length(t) >= 3 THEN list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i::BIGINT, 3))) ELSE [t] END AS g FROM n)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE, 6) AS jaccard FROM g a JOIN g b ON b.item_id = a.item_id + 1""")
def chargram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Character trigrams of each benchmark item and the next."""
    own = passages(spark, sf).select(F.col("query_id").alias("a"), T.char_ngrams(T.normalized(F.col("text")), 3).alias("g"))
    other = own.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("g").alias("h"))
    return own.join(other, "a").select("a", "b", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"))


@query(rf"""SELECT item_id, round(len(list_filter(k, lambda x: contains(lower(text), x))) / len(k)::DOUBLE, 6) AS coverage, len(k) AS n FROM (SELECT item_id, text, list_distinct({TOKENS.format("text")})[1:5] AS k0, list_slice(list_filter({TOKENS.format("text")}, lambda x: length(x) >= 2 AND x NOT IN ('of','the','a','to','in','on','for','is')), 1, 1000) AS k1 FROM benchmark) t, LATERAL (SELECT list(x ORDER BY i)[1:10] AS k FROM (SELECT x, min(i) AS i FROM (SELECT unnest(k1) AS x, unnest(range(len(k1))) AS i) GROUP BY x))""")
def keyword_coverage(spark: SparkSession, sf: str) -> DataFrame:
    own = passages(spark, sf).withColumn("k", T.keywords(F.col("text")))
    found = F.size(F.filter("k", lambda x: F.contains(F.lower("text"), x)))
    return own.select(F.col("query_id").alias("item_id"), F.round(found / F.size("k"), 6).alias("coverage"), F.size("k").alias("n"))


#: Ordered: the first that a text matches gives its type.
TYPES = (("code", r"```|def |class "), ("list", r"\|"), ("license", r"[Ll]icense"), ("contact", r"@[a-z0-9.]+\.[a-z]{2,}"), ("shout", r"!!"))


@query(f"""WITH t AS (SELECT doc_id, list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in TYPES)}], lambda x: x IS NOT NULL) AS tags FROM documents)
SELECT coalesce(tags[1], 'plain') AS kind, count(*) AS n, round(avg(CASE WHEN len(tags) <= 1 THEN 0.7::DOUBLE ELSE greatest(0.45::DOUBLE, 0.7::DOUBLE - 0.08::DOUBLE * (len(tags) - 1)) END), 6) AS confidence FROM t GROUP BY 1""")
def query_type_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = decisions.all_reasons([(F.col("text").rlike(p), n) for n, p in TYPES])
    own = documents(spark, sf).select(tags.alias("tags"))
    sure = F.when(F.size("tags") <= 1, 0.7).otherwise(F.greatest(F.lit(0.45), 0.7 - 0.08 * (F.size("tags") - 1)))
    return own.groupBy(F.coalesce(F.get("tags", F.lit(0)), F.lit("plain")).alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(sure), 6).alias("confidence"))


@query("SELECT signal, sum(n)::BIGINT AS occurrences, count(*) FILTER (WHERE n > 0) AS n_docs FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS signal, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for n, p in noise.SIGNALS) + r"""
UNION ALL SELECT 'repeated_sentence', coalesce(sum(CASE WHEN c >= 3 THEN c - 1 ELSE 0 END), 0) FROM (SELECT doc_id, trim(l) AS l, count(*) AS c FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]')) AS l FROM documents) WHERE length(trim(l)) >= 6 GROUP BY ALL) GROUP BY doc_id) GROUP BY signal""")
def noise_signals(spark: SparkSession, sf: str) -> DataFrame:
    each = documents(spark, sf).select(F.explode(noise.signals(F.col("text"))).alias("s"))
    return each.groupBy("s.signal").agg(F.sum("s.n").alias("occurrences"), F.count_if(F.col("s.n") > 0).alias("n_docs"))


@query(r"""WITH l AS (SELECT doc_id, rtrim(l) AS l, l AS raw, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
k AS (SELECT doc_id, i, regexp_replace(rtrim(regexp_replace(l, '  +', ' ', 'g')), '^$', '') AS l FROM l WHERE NOT (trim(l) <> '' AND (""" + " OR ".join(f"regexp_matches(l, '{p}')" for p in noise.WHOLE) + r"""))),
g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN l = lag(l) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS s FROM k)),
c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS r FROM g) WHERE NOT (n >= 3 AND length(trim(l)) >= 6 AND r > 1)),
b AS (SELECT * FROM (SELECT *, lag(l) OVER w AS p1, lag(l, 2) OVER w AS p2 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE NOT (trim(l) = '' AND coalesce(trim(p1) = '', false) AND coalesce(trim(p2) = '', false)))
SELECT d.doc_id, md5(coalesce(trim(string_agg(l, chr(10) ORDER BY i), chr(10) || ' '), '')) AS digest FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id""")
def line_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without lines that are noise, without markers, with repeated and blank lines cut short."""
    kept = F.filter(F.transform(noise.lines_of(F.col("text")), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: ~noise.is_noise(x))
    own = documents(spark, sf).select("doc_id", F.explode(F.array(F.transform(kept, noise.without_markers))).alias("l"))
    own = own.select("doc_id", F.explode(F.array(noise.collapsed_repeats(F.col("l")))).alias("l"))
    clean = F.regexp_replace(F.array_join(noise.limited_blanks(F.col("l")), "\n"), r"^\s+|\s+$", "")
    return own.select("doc_id", F.md5(clean.cast("binary")).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
f AS (SELECT *, CASE WHEN line = lag(line) OVER w THEN 0 ELSE 1 END AS starts FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM f), s AS (SELECT doc_id, island, count(*) AS n, any_value(line) AS line FROM g GROUP BY ALL)
SELECT doc_id, sum(CASE WHEN n >= 3 AND length(trim(line)) >= 6 THEN 1 ELSE n END)::BIGINT AS n_kept, sum(n)::BIGINT AS n_lines FROM s GROUP BY doc_id""")
def collapse_repeats(spark: SparkSession, sf: str) -> DataFrame:
    own = documents(spark, sf).select("doc_id", F.explode(F.array(F.split("text", "\n"))).alias("lines"))
    return own.select("doc_id", F.size(noise.collapsed_repeats(F.col("lines"))).alias("n_kept"), F.size("lines").alias("n_lines"))


@query(r"""WITH h AS (SELECT doc_id, trim(regexp_replace(lower(replace(coalesce(text, ''), 'ß', 'ss')), '[ \t\n\r\x0b\x0c]+', ' ', 'g')) AS t FROM documents), s AS (SELECT doc_id, substr(sha1(substring(t, 1, 512)), 1, 16) AS hash FROM h WHERE t <> '')
SELECT hash, count(*) AS n, min(doc_id) AS first FROM s GROUP BY hash HAVING count(*) > 1""")
def text_hash_dups(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that begin alike; blank ones have no hash and repeat nothing."""
    own = documents(spark, sf).select("doc_id", M.text_hash(F.col("text")).alias("hash")).where("hash <> ''")
    return own.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query()
def cer_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    """Of each turn against the one before; by characters, where DuckDB's distance counts bytes, so it has no SQL."""
    own = table(spark, sf, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", T.BLANK, " ")).alias("text"))
    after = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("got"))
    pairs = own.join(after, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(T.cer(F.col("got"), F.col("text")), 4).alias("cer"))


@query()
def wer_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Word error rate of each turn against the one before; edits between word lists have no SQL form."""
    own = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("got"))
    return own.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(M.wer(F.col("got"), F.col("text")), 6).alias("wer"))


@query(r"SELECT page_id, regexp_replace(lower(url), '[^0-9a-z]+', '', 'g') AS key FROM pages")
def document_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Ids without their case, width and separators."""
    return table(spark, sf, "pages").select("page_id", M.document_key(F.col("url")).alias("key"))


@query(r"SELECT item_id, trim(regexp_replace(lower(regexp_replace(text, '[^ㄱ-ㆎ가-힣A-Za-z0-9\s]+', ' ', 'g')), '\s+', ' ', 'g')) AS semantic, lower(trim(regexp_replace(regexp_replace(text, '[?!,.;:`~]+', ' ', 'g'), '\s+', ' ', 'g'))) AS form FROM benchmark")
def match_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The two forms in which texts are matched."""
    return table(spark, sf, "benchmark").select("item_id", M.semantic(F.col("text")).alias("semantic"), M.match_form(F.col("text")).alias("form"))


@query(r"""WITH w AS (SELECT item_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM (SELECT item_id, regexp_extract_all(trim(regexp_replace(regexp_replace(text, '[?!,.;:`~]+', ' ', 'g'), '\s+', ' ', 'g')), '[A-Za-z][A-Za-z0-9_]*') AS w FROM benchmark)),
d AS (SELECT item_id, lower(x) AS l, arg_min(x, i) AS x, min(i) AS i FROM w WHERE length(x) >= 3 GROUP BY ALL) SELECT b.item_id, coalesce(string_agg(x, '|' ORDER BY i), '') AS tokens FROM benchmark b LEFT JOIN d USING (item_id) GROUP BY b.item_id""")
def title_token_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Words that may be part of a title, each once."""
    return table(spark, sf, "benchmark").select("item_id", F.array_join(M.title_tokens(F.col("text")), "|").alias("tokens"))


@query("SELECT lang, count(*) AS n, round(avg(length(text)), 4) AS mean, quantile_disc(length(text), 0.5) AS p50, quantile_disc(length(text), 0.95) AS p95, max(length(text)) AS most, round(count(*) FILTER (WHERE length(text) > 2000) / count(*)::DOUBLE, 6) AS over FROM documents GROUP BY lang")
def length_distribution(spark: SparkSession, sf: str) -> DataFrame:
    own = documents(spark, sf).select("lang", F.length("text").alias("n_"))
    ranks = quantiles.nearest_ranks(own, "lang", "n_", {"p50": 0.5, "p95": 0.95})
    ranks = ranks.withColumnRenamed("lang", "_lang")
    out = own.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_"), 4).alias("mean"), F.max("n_").alias("most"), F.round(F.count_if(F.col("n_") > 2000) / F.count("*"), 6).alias("over"))
    return out.join(ranks, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")


@query(r"""SELECT doc_id, sha256(concat('Title: ', string_split(text, chr(10))[1], chr(10), 'Source: ', source, chr(10), chr(10), 'Body:', chr(10), text)) AS digest,
concat(substr(md5(concat_ws('|', doc_id::VARCHAR, source, '0', text)), 1, 24), '_0') AS chunk_id, concat('source_file:', source, ':unit:', lang, ':', doc_id::VARCHAR) AS index_id FROM documents""")
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text that is embedded (blank header lines left out), its digest, and stable ids."""
    line = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    header = F.concat_ws("\n", F.concat(F.lit("Title: "), F.get(F.split("text", "\n"), F.lit(0))), line("Source", F.col("source")))
    body = F.concat_ws("\n\n", header, F.concat(F.lit("Body:\n"), F.col("text")))
    chunk = F.concat(F.substring(F.md5(F.concat_ws("|", "doc_id", "source", F.lit("0"), "text").cast("binary")), 1, 24), F.lit("_0"))
    return documents(spark, sf).select("doc_id", F.sha2(body, 256).alias("digest"), chunk.alias("chunk_id"), F.concat(F.lit("source_file:"), "source", F.lit(":unit:"), "lang", F.lit(":"), F.col("doc_id").cast("string")).alias("index_id"))


@query("SELECT page_id, concat_ws(' > ', regexp_extract(url, '^https?://([^/?#]+)', 1), nullif(regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1), ''), concat('p.', (page_id % 7 + 1)::VARCHAR)) AS citation FROM pages")
def citation_text(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    page = F.concat(F.lit("p."), (F.col("page_id") % 7 + 1).cast("string"))
    return table(spark, sf, "pages").select("page_id", F.concat_ws(" > ", F.regexp_extract("url", "^https?://([^/?#]+)", 1), part("^https?://[^/]+/([a-z]+)/"), page).alias("citation"))


@query("SELECT doc_id, count(*) AS n_chunks, sum(length(w))::BIGINT AS n_chars, md5(string_agg(w, chr(30) ORDER BY i)) AS digest FROM (SELECT doc_id, i, substring(text, (i + 1)::BIGINT, 900) AS w FROM (SELECT doc_id, text, unnest(range(0, length(text), 780)) AS i FROM documents)) GROUP BY doc_id")
def chunk_window_chars(spark: SparkSession, sf: str) -> DataFrame:
    own = chunking.windows(documents(spark, sf), 900, 780)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "\x1e")
    return own.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.md5(joined.cast("binary")).alias("digest"))


@query()
def chunk_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy packing of sentences; each chunk depends on the one before, which SQL has no form of."""
    return chunking.chunked(documents(spark, sf))


@query()
def chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks within a budget of tokens, parted at the widest boundaries that fit."""
    return chunking.token_chunked(documents(spark, sf))


@query()
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's turns as a section: those of the assistant as chunks, the others as a list of role and text."""
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    chunks = F.transform(F.filter("t", lambda x: x.role == "assistant"), lambda x: x.text)
    entries = F.transform(F.filter("t", lambda x: x.role != "assistant"), lambda x: F.struct(x.role.alias("name"), x.text.alias("desc")))
    return chunking.sectioned(own.select(F.col("conv_id").alias("doc_id"), F.lit("turns").alias("section"), chunks.alias("chunks"), entries.alias("list"), F.lit(None).cast("string").alias("text")))


@query(rf"""WITH q AS (SELECT item_id, list_distinct(list_filter({TOKENS.format("text")}, lambda x: length(x) > 2)) AS terms FROM benchmark WHERE item_id < 1000000), s AS (SELECT conv_id, turn, s, i FROM (SELECT conv_id, turn, unnest(string_split(text, '.')) AS s, unnest(range(len(string_split(text, '.')))) AS i FROM conversations WHERE role = 'assistant') WHERE trim(s) <> ''),
u AS (SELECT conv_id, turn, list_distinct(list_filter({TOKENS.format("text")}, lambda x: length(x) > 2)) AS terms FROM conversations WHERE role = 'user'),
c AS (SELECT s.conv_id, s.turn, i, trim(s) AS s, len(list_intersect(u.terms, list_distinct({TOKENS.format("s")}))) AS n FROM s JOIN u ON u.conv_id = s.conv_id AND u.turn = s.turn - 1)
SELECT conv_id, turn, substring(s, 1, 240) AS answer, n AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, i) AS r FROM c) WHERE r = 1""")
def extractive_answer(spark: SparkSession, sf: str) -> DataFrame:
    """Of each answer the sentence that shares most words of over two characters with the question before it."""
    own = table(spark, sf, "conversations")
    words = lambda c: F.array_distinct(F.filter(T.tokens(c), lambda x: F.length(x) > 2))
    said = own.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", r"\.")).alias("i", "s")).where(F.trim("s") != "")
    asked = own.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), words(F.col("text")).alias("terms"))
    n = F.size(F.array_intersect("terms", T.tokens(F.col("s"))))
    best = said.join(asked, ["conv_id", "turn"]).withColumn("n", n).groupBy("conv_id", "turn").agg(F.max_by(F.struct(F.trim("s").alias("s"), "n"), F.struct("n", (-F.col("i")).alias("i"))).alias("b"))
    return best.select("conv_id", "turn", F.substring("b.s", 1, 240).alias("answer"), F.col("b.n").alias("overlap"))


@query("SELECT role, route, count(*) AS n FROM (SELECT role, CASE WHEN trim(text) = '' THEN 'reject' WHEN contains(text, '```') THEN 'code' WHEN length(trim(text)) <= 6 THEN 'clarify' WHEN contains(text, '?') THEN 'search' ELSE 'direct' END AS route FROM conversations) GROUP BY ALL")
def route_rules(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    route = decisions.first_rule([(F.trim(t) == "", "reject"), (F.contains(t, F.lit("```")), "code"), (F.length(F.trim(t)) <= 6, "clarify"), (F.contains(t, F.lit("?")), "search")], "direct")
    return table(spark, sf, "conversations").groupBy("role", route.alias("route")).agg(F.count("*").alias("n"))


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) < 40 THEN 'too_short' WHEN contains(lower(text), 'sorry') OR contains(lower(text), 'cannot') THEN 'refusal' ELSE 'sufficient' END AS verdict FROM conversations WHERE role = 'assistant') GROUP BY verdict")
def critic_rules(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lower("text")
    verdict = decisions.first_rule([(F.trim(t) == "", "empty"), (F.length(F.trim(t)) < 40, "too_short"), (F.contains(t, F.lit("sorry")) | F.contains(t, F.lit("cannot")), "refusal")], "sufficient")
    return table(spark, sf, "conversations").where("role = 'assistant'").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_roles, string_agg(role, '>' ORDER BY turn) AS trace, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def ordered_trace(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_distinct("role").alias("n_roles"), F.array_join(steps, ">").alias("trace"), F.sum(F.length("text")).alias("n_chars"))
