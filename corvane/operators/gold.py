"""Gold pages, sections and places: what a ranked result has to meet, and pools made anew by sections. Paths are arrays of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.decisions import first_rule
from corvane.operators.verdicts import holds

JOINER = " > "


def page_hit(gold: Column, got: Column) -> Column:
    return holds((gold != "") & (gold == got))


def section_hit(on_page: Column, gold: Column, got: Column) -> Column:
    """Joined paths: the page is right and the path is the gold one or below it."""
    return on_page & holds((gold != "") & ((got == gold) | got.startswith(F.concat(gold, F.lit(JOINER)))))


def joined_path(path: Column) -> Column:
    return F.array_join(F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda x: x != ""), JOINER)


def begins(path: Column, wanted: Column) -> Column:
    return holds(F.slice(path, 1, F.greatest(F.size(wanted), F.lit(1))) == wanted)


def first_page_rank(k: int, page: str = "page_id", wanted: str = "wanted_page") -> Column:
    """An aggregate: the first rank up to k with the wanted page; null without one."""
    return F.min(F.when((F.col("rank") <= k) & page_hit(F.col(wanted).cast("string"), F.col(page).cast("string")), F.col("rank")))


def path_hit(k: int, page: str = "page_id", wanted: str = "wanted_page", path: str = "path", wanted_path: str = "wanted_path") -> Column:
    """An aggregate: 1 or 0 for the wanted page with a path that begins with the wanted one; null where that is empty."""
    found = (F.col("rank") <= k) & page_hit(F.col(wanted).cast("string"), F.col(page).cast("string")) & begins(F.col(path), F.col(wanted_path))
    return F.when(F.max(F.size(wanted_path)) > 0, F.max(found.cast("int")))


def chunk_hit(k: int, chunk: str = "chunk_id", wanted: str = "wanted_chunk") -> Column:
    """An aggregate: 1 or 0 for the wanted chunk; null where none is."""
    return F.when(F.max(F.col(wanted)).isNotNull(), F.max(((F.col("rank") <= k) & holds(F.col(chunk) == F.col(wanted))).cast("int")))


def query_share(words: Column, path: Column) -> Column:
    """The share of a path's words that a query has."""
    parts = F.filter(F.split(F.array_join(path, " "), r"\s+"), lambda x: x != "")
    return F.when((F.size(parts) == 0) | (F.size(words) == 0), 0.0).otherwise(F.size(F.filter(parts, lambda x: F.array_contains(words, x))) / F.size(parts))


def best_of_page(picked: DataFrame, chunks: DataFrame, by: str = "query_id") -> DataFrame:
    """picked (by, rank, page_id, chunk_id, path, words) with the page's chunk (page_id, place, chunk_id, path) whose path the query's words
    cover best in place of its own, if that is better."""
    other = chunks.select("page_id", "place", F.col("chunk_id").alias("other"), F.col("path").alias("other_path"))
    share = F.round(query_share(F.col("words"), F.col("other_path")), 9)
    found = picked.join(other, "page_id", "left").withColumn("s", share)
    first = found.groupBy(by, "rank").agg(F.max_by(F.struct("other", "s"), F.struct("s", (-F.col("place")).alias("p"))).alias("b"))
    own = F.round(query_share(F.col("words"), F.col("path")), 9)
    out = picked.join(first, [by, "rank"]).withColumn("own", own)
    return out.select(by, "rank", "page_id", F.when(holds(F.col("b.s") > F.col("own") + 1e-9), F.col("b.other")).otherwise(F.col("chunk_id")).alias("chunk_id"))


def leaf_overlap(path: Column, wanted: Column) -> Column:
    """1 for equal paths, 0.5 where one begins the other, else up to 0.4 by the share of the wanted last name's words."""
    clean = lambda p: F.filter(F.transform(p, lambda x: F.trim(x)), lambda x: x != "")
    a, b = clean(path), clean(wanted)
    words = lambda p: F.array_distinct(F.split(F.element_at(p, -1), r"\s+"))
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, 0.0).when(a == b, 1.0).when(begins(a, b) | begins(b, a), 0.5).otherwise(0.4 * F.size(F.array_intersect(words(a), words(b))) / F.size(words(b)))


def range_met(wanted: Column, got: Column, policy: Column) -> Column:
    """Whether a found cell range meets the wanted one: exact_match, contains_expected, overlaps_expected, or none for any."""
    a, b = T.cell_range(F.replace(F.trim(wanted), F.lit("$"), F.lit(""))), T.cell_range(F.replace(F.trim(got), F.lit("$"), F.lit("")))
    plain = F.upper(F.trim(wanted)) == F.upper(F.trim(got))
    ranged = F.when(policy == "exact_match", a == b).when(policy == "contains_expected", T.contains_range(b, a)).when(policy == "overlaps_expected", T.overlaps(a, b)).otherwise(False)
    met = F.when(a.isNull() | b.isNull(), plain).otherwise(ranged)
    return F.when((policy == "none") | (F.coalesce(wanted, F.lit("")) == ""), True).when(F.coalesce(got, F.lit("")) == "", False).otherwise(met)


def boxes_overlap(a: Column, b: Column) -> Column:
    """Boxes of x0, y0, x1, y1; false unless both have four numbers."""
    four = (F.size(a) == 4) & (F.size(b) == 4)
    at = F.get
    return four & holds((at(a, F.lit(0)) <= at(b, F.lit(2))) & (at(b, F.lit(0)) <= at(a, F.lit(2))) & (at(a, F.lit(1)) <= at(b, F.lit(3))) & (at(b, F.lit(1)) <= at(a, F.lit(3))))


def boxes_equal(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return (F.size(a) == 4) & (F.size(b) == 4) & F.forall(F.zip_with(a, b, lambda x, y: holds(F.abs(x - y) <= tolerance + 1e-12)), lambda x: x)


def location_met(want: Column, got: Column) -> Column:
    """want: kind, sheet, tbl, cells, policy, physical, page, label, box; got: sheet, tbl, cells, physical, page, label, box. Empty and null wishes are met by anything."""
    text = lambda c: (F.coalesce(want[c], F.lit("")) == "") | holds(want[c] == got[c])
    number = lambda c: want[c].isNull() | holds(want[c] == got[c])
    sheet = text("sheet") & text("tbl") & range_met(want.cells, got.cells, F.coalesce(F.nullif(want.policy, F.lit("")), F.lit("none")))
    page = number("physical") & number("page") & text("label") & (want.box.isNull() | boxes_overlap(want.box, got.box))
    return F.when(want.kind == "xlsx", sheet).when(want.kind.isin("pdf", "ocr"), page).otherwise(True)


def leaks(policy: Column, terms: Column, hit: Column) -> Column:
    """Whether the serialised hit has a blocked term (terms parted by ; or |), where hidden content is to stay away."""
    blocked = F.filter(F.transform(F.split(F.coalesce(terms, F.lit("")), "[;|]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return policy.isin("exclude_hidden", "negative") & F.exists(blocked, lambda x: F.contains(F.lower(hit), x))


def failure_reason(want: Column, seen: Column) -> Column:
    """Why a gold row without a matching hit failed; seen has what hits met: hits, index, version, status, file, and of the hits of the file: sheet, of
    these tbl, of these (or, where no table is wanted, of the sheet's) cells, and page, of these box (see golden.evaluated)."""
    sheets = want.kind == "xlsx"
    pages = want.kind.isin("pdf", "ocr")
    given = lambda c: F.coalesce(want[c].cast("string"), F.lit("")) != ""
    return first_rule([
        (seen.hits == 0, "search_result_empty"),
        (~seen.index, "candidate_index_mismatch"),
        (~seen.version, "required_index_version_mismatch"),
        (~seen.status, "embedding_status_mismatch"),
        (~seen.file, "expected_file_not_found"),
        (sheets & given("sheet") & ~seen.sheet, "expected_sheet_not_found"),
        (sheets & given("tbl") & ~seen.tbl, "expected_table_not_found"),
        (sheets & given("cells") & ~seen.cells, "expected_range_not_found"),
        (pages & (given("physical") | given("page")) & ~seen.page, "expected_page_not_found"),
        (pages & want.box.isNotNull() & ~seen.box, "bbox_mismatch"),
    ], "unknown")


#: Fixed: flags of a labelled result.
FLAGS = ("wrong_page", "right_page_wrong_section", "evidence_too_noisy", "needs_cross_section", "needs_subpage")


def answerable(labels: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """By variant over rows (variant, query_id, rank, label, page_hit, section_hit, flags): queries and rows, the shares of queries with a partly (2) and
    a fully (3) answering result in the first k, and, in the first five, queries on the page that nothing answers, queries that are answered without a hit of
    the section, and how often each flag is set."""
    best = lambda k, level: F.max(F.when((F.col("rank") <= k) & (F.col("label") >= level), 1).otherwise(0))
    early = F.col("rank") <= 5
    flag = lambda c: F.max((early & c).cast("int"))
    flags = [F.count_if(early & F.array_contains("flags", x)).alias(x) for x in FLAGS]
    each = labels.groupBy("variant", "query_id").agg(
        *[best(k, n).alias(f"{name}_{k}") for k in ks for name, n in (("answerable", 2), ("fully", 3))],
        F.count("*").alias("rows"), flag(F.col("page_hit")).alias("page"), flag(F.col("section_hit")).alias("section"), flag(F.col("label") >= 2).alias("answers"), *flags,
    )
    rates = [F.round(F.avg(f"{name}_{k}"), 6).alias(f"{name}_{k}") for k in ks for name in ("answerable", "fully")]
    page_only, off_section = F.count_if(F.expr("page = 1 and answers = 0")), F.count_if(F.expr("answers = 1 and section = 0"))
    return each.groupBy("variant").agg(F.count("*").alias("queries"), F.sum("rows").alias("rows"), *rates, page_only.alias("page_only"), off_section.alias("off_section"), *[F.sum(x).alias(x) for x in FLAGS])


def bundles(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """query_id, k, label, text of the context made of a query's first k results (query_id, rank, title, text, label): numbered passages, and the best label."""
    each = rows.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("text"))
    return each.groupBy("query_id", "k").agg(F.max("label").alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x.line), "\n\n").alias("text"))


def difficulty(kind: Column, gold_rank: Column, gold_score: Column, top: Column, easy: float, medium: float, impossible: float) -> Column:
    """A question's difficulty by where its gold document stands; null drops it."""
    return first_rule([((kind == "unanswerable") & (F.coalesce(top, F.lit(0.0)) < impossible), "impossible"), (kind == "unanswerable", "hard"), (holds((gold_rank == 1) & (gold_score >= easy)), "easy"), (holds((gold_rank <= 3) & (gold_score >= medium)), "medium"), (gold_rank.isNotNull(), "hard")], None)


def reranked(pool: DataFrame, score: Column, k: int, by: str = "query_id", pos: str = "rank") -> DataFrame:
    """The first k by a reranker's score, kept in the old order where it has none; adds rank_before, rank."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("_s"), "rank_before")
    out = pool.withColumn("_s", score).withColumnRenamed(pos, "rank_before")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_s")
