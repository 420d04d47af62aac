"""Texts built of a unit's fields: what is embedded, searched, cited and reranked. Blank fields drop their line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.operators.decisions import first_rule

#: Fixed: most keywords of a prefix, characters of a preview, and of a question made of recognised text.
KEYWORDS, PREVIEW, QUERY = 8, 240, 200


def filled(value: Column) -> Column:
    """The trimmed text, null if blank."""
    return F.nullif(F.trim(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")), F.lit(""))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*map(filled, values))


def line(label: str, value: Column) -> Column:
    return F.when(filled(value).isNotNull(), F.concat(F.lit(f"{label}: "), filled(value)))


def lines(*values: Column) -> Column:
    return F.concat_ws("\n", *values)


def with_content(head: Column, body: Column) -> Column:
    """Header lines, then a blank line and the body, where there is one."""
    content = F.concat(F.lit("Content:\n"), filled(body))
    return F.coalesce(F.when(filled(body).isNotNull(), F.concat_ws("\n\n", F.nullif(head, F.lit("")), content)), head)


def header_text(headers: Column) -> Column:
    """Header paths (arrays of names) joined by > and by bars."""
    paths = F.transform(headers, lambda path: F.array_join(F.filter(F.transform(path, lambda x: F.trim(x)), lambda x: x != ""), " > "))
    return F.nullif(F.array_join(F.filter(paths, lambda x: x != ""), " | "), F.lit(""))


def box_text(box: Column) -> Column:
    return F.when(F.size(box) > 0, F.concat(F.lit("["), F.array_join(F.transform(box, lambda x: x.cast("string")), ","), F.lit("]")))


def citation(kind: Column, file: Column, place: Column) -> Column:
    """file > sheet > range of a sheet (workbook for a whole one), file > p.N > bbox of a page. place has sheet, cells, unit_key, page, box."""
    rest = F.when(place.unit_key == "workbook", "workbook")
    sheet = F.concat_ws(" > ", file, filled(place.sheet), F.coalesce(filled(place.cells), rest))
    page = F.concat_ws(" > ", file, F.concat(F.lit("p."), filled(place.page)), F.concat(F.lit("bbox "), box_text(place.box)))
    return F.when(kind == "xlsx", sheet).otherwise(page)


def chunk_type(kind: Column, role: Column, block: Column, canonical: Column) -> Column:
    return first_rule([
        ((kind == "xlsx") & (role == "workbook"), F.lit("workbook_summary")),
        ((kind == "xlsx") & (role == "sheet"), F.lit("sheet_summary")),
        ((kind == "xlsx") & (role == "table"), F.lit("table")),
        ((kind == "xlsx") & (role == "chunk"), F.lit("row_group")),
        ((kind == "pdf") & (role == "document"), F.lit("document_summary")),
        ((kind == "pdf") & (role == "page"), F.lit("page")),
        ((kind == "pdf") & (role == "block"), F.coalesce(filled(block), F.lit("paragraph"))),
        (canonical == "DOCUMENT", F.lit("document_summary")),
        (canonical == "IMAGE", F.lit("figure_caption")),
        (canonical == "CHUNK", F.lit("ocr_block")),
    ], F.coalesce(F.lower(canonical), F.lit("chunk")))


def unit_text(kind: Column, file: Column, cited: Column, chunk: Column, place: Column, title: Column, section: Column, body: Column) -> Column:
    """The labelled text that is embedded. place has also tbl, headers, page_label, block, ocr, sure."""
    top = [line("Source", file), line("Citation", cited), line("Chunk", chunk)]
    sheet = lines(*top, line("Sheet", place.sheet), line("Table", place.tbl), line("Range", place.cells), line("Headers", header_text(place.headers)))
    read = F.coalesce(place.ocr, F.lit(False))
    page = lines(*top, line("Page", first_filled(place.page_label, place.page)), line("Section", section), line("Block", place.block), F.when(read, F.lit("OCR: used")), F.when(read, line("OCR confidence", place.sure)))
    content = F.concat(F.lit("Content:\n"), first_filled(body, title))
    return F.concat_ws("\n", F.when(kind == "xlsx", sheet).otherwise(page), content)


def search_text(*values: Column) -> Column:
    """What lexical search indexes: the filled values, a line each."""
    return lines(*map(filled, values))


def location_json(kind: Column, version: Column, place: Column) -> Column:
    """The place of a unit as JSON; a page's physical index is one less than its number where it isn't given."""
    sheet = F.to_json(F.struct(F.lit("xlsx").alias("type"), version.alias("document_version_id"), filled(place.sheet).alias("sheet_name"), filled(place.tbl).alias("table_id"), filled(place.cells).alias("cell_range"), F.lit("exclude_hidden").alias("hidden_policy")))
    number = place.page.cast("int")
    page = F.to_json(F.struct(kind.alias("type"), version.alias("document_version_id"), F.greatest(F.lit(0), number - 1).alias("physical_page_index"), number.alias("page_no"), first_filled(place.page_label, place.page).alias("page_label"), place.box.alias("bbox"), (F.coalesce(place.ocr, F.lit(False)) | (kind != "pdf")).alias("ocr_used"), place.sure.alias("ocr_confidence")))
    return F.when(kind == "xlsx", sheet).otherwise(page)


def prefix_text(variant: str, title: Column, section: Column, words: Column, text: Column) -> Column:
    """A text behind its title, section and keywords, as the variant asks."""
    parts = {"raw": (), "title": ("t",), "section": ("s",), "title_section": ("t", "s"), "keyword": ("k",), "all": ("t", "s", "k")}[variant]
    of = {"t": filled(title), "s": filled(section), "k": filled(keyword_line(words))}
    return lines(*[of[x] for x in parts], filled(text))


def keyword_line(words: Column, most: int = KEYWORDS) -> Column:
    """Distinct keywords in any case, the first spelling of each, `most` of them."""
    clean = F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(clean, lambda x: F.lower(x))
    return F.array_join(F.transform(F.slice(F.array_distinct(low), 1, most), lambda x: F.element_at(clean, F.array_position(low, x).cast("int"))), " ")


def resolved_title(variant: str, page_title: Column, retrieval_title: Column) -> Column:
    page = F.coalesce(filled(page_title), F.lit(""))
    return page if variant == "title_section" else F.coalesce(filled(retrieval_title), page)


#: Fixed: labels of a text that is embedded in production.
LABELS = ("제목", "섹션", "섹션타입", "본문")


def production_text(variant: str, page_title: Column, retrieval_title: Column, path: Column, kind: Column, body: Column) -> Column:
    """The text that is embedded, of title_section or retrieval_title_section: labelled lines of what is filled, then the body."""
    if variant not in ("title_section", "retrieval_title_section"):
        raise ValueError(f"no such variant: {variant}")
    trimmed = lambda c: filled(F.trim(c))
    section = F.array_join(F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), " > ")
    title = resolved_title(variant, F.trim(page_title), F.trim(retrieval_title))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    head = filled(F.concat_ws("\n", line(LABELS[0], filled(title)), line(LABELS[1], filled(section)), line(LABELS[2], trimmed(kind))))
    return F.concat_ws("\n\n", head, F.concat(F.lit(f"{LABELS[3]}:\n"), trimmed(body)))


def passage(form: str, text: Column, title: Column, section: Column) -> Column:
    """What a reranker reads."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", "")
    title, section = filled(title), filled(section)
    told = F.concat(F.lit("본문: "), body)
    if form == "title_plus_chunk":
        return F.when(title.isNull(), body).otherwise(lines(F.concat(F.lit("제목: "), title), told))
    if form == "title_section_plus_chunk":
        return lines(F.concat(F.lit("제목: "), title), F.concat(F.lit("섹션: "), section), told)
    if form == "compact_metadata_plus_chunk":
        head = F.nullif(F.concat_ws(" / ", title, section), F.lit(""))
        return F.concat(F.when(head.isNull(), "").otherwise(F.concat(F.lit("["), head, F.lit("]\n"))), body)
    return body


def same_unit_key(unit: Column, source: Column, kind: Column, key: Column, chunk: Column, doc: Column, section: Column) -> Column:
    """By what two results are the same: the unit, else its place in a source, else the chunk, else document and section."""
    placed = filled(source).isNotNull() & filled(kind).isNotNull() & filled(key).isNotNull()
    return F.when(filled(unit).isNotNull(), F.concat(F.lit("search_unit:"), unit)).when(placed, F.concat(F.lit("source_file:"), source, F.lit(":unit:"), kind, F.lit(":"), key)).when(filled(chunk).isNotNull(), F.concat(F.lit("chunk:"), chunk)).otherwise(F.concat(F.lit("doc:"), doc, F.lit(":section:"), F.coalesce(section, F.lit(""))))


def result_row(r: Column) -> Column:
    """A result as it is handed out; r has rank, chunk_id, doc_id, section, score, text, dense, sparse, rerank, unit, source, kind, path."""
    shown = F.when(F.length(r.text) > PREVIEW, F.concat(F.rtrim(F.substring(r.text, 1, PREVIEW)), F.lit("..."))).otherwise(r.text)
    dense = F.coalesce(F.nullif(r.dense, F.lit(0.0)), r.score)  # a dense score of zero counts as none
    cited = F.struct(F.coalesce(filled(r.source), r.doc_id).alias("sourceFileId"), F.coalesce(filled(r.unit), r.chunk_id).alias("searchUnitId"), F.coalesce(filled(r.kind), F.lit("CHUNK")).alias("unitType"), F.coalesce(filled(r.path), r.section).alias("sectionPath"))
    return F.struct(r["rank"].alias("rank"), r.chunk_id.alias("chunkId"), r.doc_id.alias("docId"), F.round(r.score, 6).alias("score"), shown.alias("snippet"), F.round(dense, 6).alias("denseScore"), F.round(r.sparse, 6).alias("sparseScore"), F.round(r.rerank, 6).alias("rerankScore"), cited.alias("citation"))


def retrieval_query(question: Column, read: Column, caption: Column, most: int = QUERY, short: int = 4) -> Column:
    """The question, with the head of the recognised text if it is short; else that head, else the caption, else a neutral one."""
    question, read, caption = filled(question), filled(read), filled(caption)
    few = F.size(F.split(question, r"\s+")) < short
    head = F.substring(read, 1, most)
    return F.when(question.isNotNull() & few & read.isNotNull(), F.concat(question, F.lit(" "), head)).otherwise(F.coalesce(question, head, caption, F.lit("document")))


def fused_context(question: Column, read: Column, seen: Column) -> Column:
    """Three sections, empty ones marked; seen is an array of captions by page."""
    told = F.array_join(F.transform(F.filter(seen, lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("- "), F.trim(x))), "\n")
    part = lambda name, value: F.concat(F.lit(f"[{name}]\n"), F.coalesce(filled(value), F.lit("(empty)")))
    return F.concat_ws("\n\n", part("question", question), part("ocr", read), part("vision", told))
