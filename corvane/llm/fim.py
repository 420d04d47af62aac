"""Fill-in-middle transformation over ropes.

A text is a balanced tree of immutable leaves; each node caches how many units and code points it holds. Splitting the tree at two
unit ranks gives prefix, middle and suffix in logarithmic time; the output is the concatenation of these subtrees, rearranged,
with sentinels between them. The inverse builds a rope of the output, splits it at the sentinels and puts the subtrees back.
A unit is a code point, or whatever a pattern matches (`unit`), with what stands before a match belonging to it.

Nothing is shuffled: forms and cuts are column expressions of doc_id and the text, ropes live within a row.

Defined results: a null text is an empty one, which is plain; a null doc_id has the digest of no digits. A text that holds a sentinel
is plain, so an output that is not plain has each sentinel once. Repeated rows have equal results; further columns are not looked at.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common

LEAF = 2048  # units in a leaf
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Rope:
    """A node: a leaf has `text` (and, where units are not code points, the `ends` of its units), an inner node `left` and `right`."""

    __slots__ = ("ends", "height", "left", "points", "right", "text", "units")

    def __init__(self, text: str = "", ends: list[int] | None = None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.ends, self.left, self.right = text, ends, left, right
        if left is None:
            self.points, self.units, self.height = len(text), len(text) if ends is None else len(ends), 0
        else:
            self.points, self.units = left.points + right.points, left.units + right.units
            self.height = 1 + max(left.height, right.height)

    def __str__(self) -> str:
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                parts.append(node.text)
            else:
                todo += [node.right, node.left]
        return "".join(parts)


def built(text: str, unit: str | None = None, size: int = LEAF) -> Rope:
    """The rope of a text; the last unit takes what stands after the last match."""
    if unit is None:
        row = [Rope(text[i : i + size]) for i in range(0, len(text), size)]
    else:
        ends = [x.end() for x in regex.finditer(unit, text)]
        if ends:
            ends[-1] = len(text)
        elif text:
            ends = [len(text)]
        row, start = [], 0
        for i in range(0, len(ends), size):
            some = ends[i : i + size]
            row.append(Rope(text[start : some[-1]], [x - start for x in some]))
            start = some[-1]
    while len(row) > 1:
        row = [Rope(left=row[i], right=row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0] if row else Rope(text, None if unit is None else [])


def _level(left: Rope, right: Rope) -> Rope:
    """A node over two trees whose heights differ by two at most, rotated where they do."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Rope(left=left.left, right=Rope(left=left.right, right=right))
        mid = left.right
        return Rope(left=Rope(left=left.left, right=mid.left), right=Rope(left=mid.right, right=right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Rope(left=Rope(left=left, right=right.left), right=right.right)
        mid = right.left
        return Rope(left=Rope(left=left, right=mid.left), right=Rope(left=mid.right, right=right.right))
    return Rope(left=left, right=right)


def joined(left: Rope, right: Rope) -> Rope:
    """Concatenation, in time of the difference of heights."""
    if not left.points:
        return right
    if not right.points:
        return left
    if left.height > right.height + 1:
        return _level(left.left, joined(left.right, right))
    if right.height > left.height + 1:
        return _level(joined(left, right.left), right.right)
    return Rope(left=left, right=right)


def split(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if node.left is None:
        at = rank if node.ends is None else node.ends[rank - 1] if rank else 0
        heads, tails = (None, None) if node.ends is None else (node.ends[:rank], [x - at for x in node.ends[rank:]])
        return Rope(node.text[:at], heads), Rope(node.text[at:], tails)
    if rank <= node.left.units:
        head, tail = split(node.left, rank)
        return head, joined(tail, node.right)
    head, tail = split(node.right, rank - node.left.units)
    return joined(node.left, head), tail


def arranged(text: Rope, a: int, b: int, form: str) -> tuple[str, int, int]:
    """The output, and the code points of prefix and middle, of a text cut after a and b units."""
    head, suffix = split(text, b)
    prefix, middle = split(head, a)
    out = Rope()
    order = ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)) if form == "psm" else ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))
    for mark, part in order:
        out = joined(joined(out, Rope(mark)), part)
    return str(out), prefix.points, middle.points


def restored(output: str, form: str) -> str:
    """The text of an output, from its form."""
    if form == "plain":
        return output
    marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    rest, at, parts = built(output), 0, {}
    for i, mark in enumerate(marks):
        _, rest = split(rest, len(mark))  # the mark itself
        at += len(mark)
        end = output.index(marks[i + 1], at) if i < 2 else len(output)
        parts[mark], rest = split(rest, end - at)
        at = end
    return str(joined(joined(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def plans(docs: DataFrame, plain: int = 10, spm: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, text, form, h1, h2: percentages of plain texts, and of spm among the others, drawn from a digest of doc_id."""
    own = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    own = own.withColumn("_digest", digest)

    def drawn(i: int) -> Column:
        return F.conv(F.substring("_digest", 8 * i - 7, 8), 16, 10).cast("long")

    stays = (F.col("text") == "") | (drawn(3) % 100 >= 100 - plain)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        stays = stays | F.contains("text", F.lit(mark))
    form = F.when(stays, "plain").when(drawn(4) % 100 < spm, "spm").otherwise("psm")
    return own.select("doc_id", "text", form.alias("form"), drawn(1).alias("h1"), drawn(2).alias("h2"))


def transformed(docs: DataFrame, unit: str | None = None, **rates: int) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every document."""
    def step(batch: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("n", "prefix_chars", "middle_chars", "output")}
        for text, form, h1, h2 in zip(*(batch[x].to_pylist() for x in ("text", "form", "h1", "h2")), strict=True):
            own = built(text, unit)
            n, prefix, middle, output = own.units, None, None, text
            if form != "plain":
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                output, prefix, middle = arranged(own, a, b, form)
            for k, v in zip(out, (n, prefix, middle, output), strict=True):
                out[k].append(v)
        out["prefix_chars"], out["middle_chars"] = (pa.array(out[x], pa.int64()) for x in ("prefix_chars", "middle_chars"))
        return {"doc_id": batch["doc_id"], "form": batch["form"], **out}

    return common.per_batch(plans(docs, **rates), step, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", rows=1000)


def with_restored(rows: DataFrame) -> DataFrame:
    """`transformed` rows with `restored`, the text rebuilt of output and form alone."""
    kinds = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def step(batch: dict) -> dict:
        texts = [restored(x, y) for x, y in zip(batch["output"].to_pylist(), batch["form"].to_pylist(), strict=True)]
        return {k: v for k, v in batch.items() if k} | {"restored": texts}

    return common.per_batch(common.pick(rows, *(x.split(" ")[0] for x in kinds.split(", "))), step, f"{kinds}, restored string", rows=1000)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_restored(transformed(common.table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(x).cast("binary"), 256).alias(f"{x}_sha256") for x in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
),
f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || left(t, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || left(t, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""
