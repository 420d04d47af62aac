"""Removal of passages that an earlier document has, by maximal repeats of enhanced suffix arrays over anchored contexts.

Two equal windows of 50 bytes have the same least k-gram hash at the same place, their anchor. So the windows of all texts are
dealt by their anchors: an anchor's context is the stretch of text whose windows it is the anchor of, and the contexts of one
anchor hold all places of each of their windows. Anchors met in one text only are left out before contexts are cut. The contexts
that meet are put into an enhanced suffix array; a stack scan of its common-prefix intervals, with a test of what stands before,
gives maximal repeats with all their places, and in all documents but the first of a repeat its bytes are removed. Every window
is in such a repeat with all its places, so the bytes removed are those of the windows that start in an earlier document too.

Texts never move: tasks send anchor hashes and contexts, and what is found comes back in files by part of the input, from which
the tasks that scan the same part again take what is theirs. Exact copies are told by digests alone and send no anchors. While one
text alone has an anchor, all its places are held, so that none is lost when a later turn of the shard brings a second text; there are
as many shards as keep some `SHARD_BYTES` of text in each. A shared anchor in more than `hot` places (or in a ten-millionth of all
such places, if that is more, so that at most ten million hashes are broadcast) is cut further: its windows are grouped by their own
digests, where the first document is a sum before the shuffle. Contexts are equal if their bytes are, a hash only brings them together.

Defined results: a null text is an empty one. A null doc_id counts as greater than all ids. Rows with equal ids don't take from
each other, and repeated rows have equal results. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.anchors import SPAN, Anchors
from corvane.llm.suffix_tree import SuffixArray

HOT, FLUSH, CHUNK, BUFFER, ROWS, SALTS = 30_000, 500_000, 1 << 20, 30_000, 1500, 16
SHARD_BYTES, HOT_ANCHORS = 32 << 20, 10_000_000
LAST = (1 << 63) - 1
HOTS = -1  # the part under which shards name hot anchors


def parts_of(docs: DataFrame) -> DataFrame:
    """part (a digest of the file and place in it that a row is read from), did, doc_id, text in bytes."""
    own = common.pick(docs, "doc_id", "text")
    part = F.abs(F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    return own.select(part.alias("part"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.col("doc_id").cast("long").alias("doc_id"), common.as_bytes(F.col("text")).alias("text"))


def text_id(text: bytes) -> int:
    return int.from_bytes(hashlib.md5(text).digest()[:8], "little", signed=True)


def in_chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, texts[start:]


def _packed(arrays: list[np.ndarray]) -> bytes:
    planes = [np.array([x.itemsize, len(x)], dtype="<u4").tobytes() + x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(body: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    for kind in kinds:
        width, n = np.frombuffer(raw, "<u4", 2, at).tolist()
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at + 8).reshape(width, n).T).view(kind).ravel())
        at += 8 + width * n
    return out


class Answers:
    """What a task takes from the files of the parts that it scans, as `make` has it of a part's table (None where it has none). Holds one part at a time
    and makes it once, so that a part's batches don't each go through all of its answers."""

    def __init__(self, path: str, columns: list[str], make: Callable[[pa.Table | None], object]) -> None:
        self.path, self.columns, self.make, self.part, self.made = path, columns, make, None, None

    def of(self, part: int):
        if part != self.part:
            self.made = None
            self.part, self.made = part, self.make(common.folder_table(f"{self.path}/part={part}", self.columns))
        return self.made


def _copies(path: str) -> Answers:
    """The part's copies of earlier texts, as (text, did)."""
    return Answers(path, ["text", "did"], lambda x: set(zip(x["text"].to_pylist(), x["did"].to_pylist(), strict=True)) if x is not None else set())


def _by_text(table: pa.Table | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids of the texts of told anchors, ends, and each text's places in turn; bodies are unpacked one at a time."""
    if table is None:
        return None
    kinds, counts = ["<i8", "<u4", "<u4"], []
    for body in table["body"]:
        ids, n, _ = _unpacked(body.as_py(), kinds)
        counts.append((ids, n))
    known, of = np.unique(np.concatenate([x for x, _ in counts]), return_inverse=True)
    ends = np.cumsum(np.bincount(of, np.concatenate([n for _, n in counts]), len(known)).astype(np.int64))
    del counts, of
    places, free = np.empty(int(ends[-1]) if len(ends) else 0, "<u4"), np.concatenate([[0], ends[:-1]])
    for body in table["body"]:
        ids, n, number = _unpacked(body.as_py(), kinds)
        n, at = n.astype(np.int64), np.searchsorted(known, ids)  # a text is in a body once
        places[np.arange(len(number)) + np.repeat(free[at] - (np.cumsum(n) - n), n)] = number
        free[at] += n
    return known, ends, places


def _by_row(table: pa.Table | None) -> tuple[dict, np.ndarray, np.ndarray]:
    """Where the spans of a text of an id are, and the spans."""
    if table is None:
        return {}, np.empty(0, np.int64), np.empty(0, np.int64)
    text, did, at, length = (table[x].to_numpy() for x in ("text", "did", "at", "length"))
    order = np.lexsort((did, text))
    text, did, at, length = text[order], did[order], at[order], length[order]
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(did) != 0)]))
    return {(t, d): (a, b) for t, d, a, b in zip(text[cuts].tolist(), did[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(text)], strict=True)}, at, length


def _by_part(batch: dict) -> Iterator[tuple[int, int, int]]:
    parts = np.asarray(batch["part"])
    cuts = np.flatnonzero(np.diff(parts, prepend=parts[0] - 1))
    yield from zip(parts[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(parts)], strict=True)


def _sent(rows: DataFrame, shards: int, copies: str) -> DataFrame:
    """shard, body: the anchors of a batch of texts that aren't exact copies of an earlier one, by shard: for each text its part, id and number of anchors; for each anchor its hash and the step to its place among the text's anchors."""
    def setup() -> Answers:
        return _copies(copies)

    def step(batch: dict) -> dict | None:
        texts, dids = batch["text"].to_pylist(), batch["did"].to_pylist()
        part, ids = np.asarray(batch["part"]), np.array([text_id(x) for x in texts], dtype=np.int64)
        live: list[int] = []
        for at, start, end in _by_part(batch):
            gone = batch[""].of(at)
            live += [i for i in range(start, end) if (int(ids[i]), dids[i]) not in gone]
        if not live:
            return None
        texts, part, ids = [texts[i] for i in live], part[live], ids[live]
        hashes, numbers, of = [], [], []
        for start, chunk in in_chunks(texts):
            a = Anchors(chunk)
            hashes.append(a.hash)
            numbers.append(a.number)
            of.append(a.text + start)
        hashed, number, of = np.concatenate(hashes), np.concatenate(numbers), np.concatenate(of)
        shard = ((hashed >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        out: dict = {"shard": [], "body": []}
        for s in np.unique(shard).tolist():
            at = order[cuts[s] : cuts[s + 1]]
            if len(at):
                texts_in, first, n = np.unique(of[at], return_index=True, return_counts=True)
                steps = np.diff(number[at], prepend=0)
                steps[first] = number[at][first]
                out["shard"].append(s)
                out["body"].append(_packed([part[texts_in], ids[texts_in], n.astype("<u4"), hashed[at], steps.astype("<u4")]))
        return out

    return common.per_batch(rows.select("part", "did", "text"), step, "shard int, body binary", setup)


class Shared:
    """The anchors of a shard seen so far: all places of those that one text alone has, one of the others, in how many places it is, and whether it was told."""

    def __init__(self) -> None:
        none = np.empty(0, np.int64)
        self.hash, self.part, self.text, self.number, self.n = none.astype(np.uint64), none, none, none, none
        self.known = np.empty(0, bool)

    def add(self, hashed: np.ndarray, part: np.ndarray, text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, text, number) of all places, not told before, of anchors now known to be in more than one text."""
        k = len(self.hash)
        hashed, part, text, number = (np.concatenate(x) for x in ((self.hash, hashed), (self.part, part), (self.text, text), (self.number, number)))
        known = np.concatenate([self.known, np.zeros(len(hashed) - k, bool)])
        n = np.concatenate([self.n, np.ones(len(hashed) - k, np.int64)])
        order = np.argsort(hashed, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(hashed[order]) > 0]))
        run = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(order))))
        shared = np.logical_or.reduceat((text[order] != text[order][cuts][run]) | known[order], cuts)
        told = shared[run] & ~known[order]
        out = part[order][told], text[order][told], number[order][told]
        n[order[cuts[shared]]] = np.add.reduceat(n[order], cuts)[shared]
        held = ~shared[run]
        held[cuts] = True
        self.hash, self.part, self.text, self.number, self.n = (x[order][held] for x in (hashed, part, text, number, n))
        self.known = shared[run][held]
        return out


def _shared(sent: DataFrame, shards: int, hot: int, size: int) -> DataFrame:
    """part, body: anchors that more than one text has (ids of texts, how many of each, their places among the text's anchors), a row
    for each part and turn of a shard, of some `size` anchors; under part HOTS, the hashes of anchors in more than `hot` places, with their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(part: np.ndarray, text: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((number, text, part))
            part, text, number = part[order], text[order], number[order].astype("<u4")
            cuts = np.flatnonzero(np.diff(part, prepend=part[0] - 1)).tolist() if len(part) else []
            bodies = []
            for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
                ids, n = np.unique(text[a:b], return_counts=True)
                bodies.append(_packed([ids, n.astype("<u4"), number[a:b]]))
            if bodies:
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(bodies, pa.binary())], ["part", "body"])

        def end() -> Iterator[pa.RecordBatch]:
            yield from flush()
            large = own.known & (own.n > hot)
            if large.any():
                body = _packed([own.hash[large].view(np.int64), own.n[large]])
                yield pa.RecordBatch.from_arrays([pa.array([HOTS]), pa.array([body], pa.binary())], ["part", "body"])

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from told(*own.add(*(np.concatenate([x[i] for x in held]) for i in range(4))))
                held.clear()

        shard, own, held = None, Shared(), []
        for batch in batches:
            for at, body in zip(batch["shard"].to_pylist(), batch["body"].to_pylist(), strict=True):
                if at != shard:
                    if shard is not None:
                        yield from end()
                    shard, own = at, Shared()
                part, ids, n, hashed, steps = _unpacked(body, ["<i8", "<i8", "<u4", "<u8", "<u4"])
                firsts = np.cumsum(n) - n
                total = np.cumsum(steps.astype(np.int64))
                base = np.where(firsts > 0, total[np.maximum(firsts.astype(np.int64) - 1, 0)], 0)
                held.append((hashed, np.repeat(part, n), np.repeat(ids, n), total - np.repeat(base, n)))
                if sum(len(x[0]) for x in held) > size:
                    yield from flush()
        if shard is not None:
            yield from end()

    return sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "part long, body binary")


CONTEXT = "hash long, context binary, did long, part long, text long, at long"
WINDOW = "key binary, did long, part long, text long, at long"


def _contexts(rows: DataFrame, shared: str, copies: str, hot, only_hot: bool) -> DataFrame:
    """The stretches of text of shared anchors, in texts that aren't exact copies of an earlier one, with their place: of anchors that
    aren't hot by the anchor's hash, or of hot ones cut to windows, by the window's digest."""
    schema = WINDOW if only_hot else CONTEXT
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def setup() -> tuple:
        return Answers(shared, ["body"], _by_text), _copies(copies), np.sort(hot.value)

    def step(batch: dict) -> dict:
        answers, copied, hots = batch[""]
        out: dict[str, list] = {x: [] for x in names}
        for part, start, end in _by_part(batch):
            found = answers.of(part)
            if found is None:
                continue
            texts, ids = batch["text"].slice(start, end - start).to_pylist(), batch["did"].slice(start, end - start).to_pylist()
            known = [text_id(x) for x in texts]
            held, upto, places = found
            gone, at = copied.of(part), np.searchsorted(held, known).tolist()
            live = [i for i, x in enumerate(at) if x < len(held) and held[x] == known[i] and (known[i], ids[i]) not in gone]
            for first, chunk in in_chunks([texts[i] for i in live]):
                a = Anchors(chunk)
                bases = np.searchsorted(a.text, np.arange(len(chunk)))
                which = np.concatenate([bases[j] + places[upto[x - 1] if x else 0 : upto[x]].astype(np.int64) for j, x in enumerate(at[i] for i in live[first : first + len(chunk)])])
                which = which[np.isin(a.hash[which].view(np.int64), hots) == only_hot]
                if not len(which):
                    continue
                low, high = a.owned(which)
                if only_hot:
                    n = high - low + 1
                    ends = np.cumsum(n)
                    low = np.unique(np.arange(ends[-1]) + np.repeat(low - (ends - n), n))
                    raw = a.bytes.tobytes()
                    out["key"].append(pa.array([xxhash.xxh3_128_digest(raw[x : x + SPAN]) for x in low.tolist()], pa.binary()))
                    of = np.searchsorted(a.ends, low, side="right")
                else:
                    size = high + SPAN - low
                    ends = np.cumsum(size)
                    take = np.arange(ends[-1]) + np.repeat(low - (ends - size), size)
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    out["context"].append(pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(a.bytes[take].tobytes())]))
                    out["hash"].append(pa.array(a.hash[which].view(np.int64)))
                    of = a.text[which]
                doc = np.array([live[first + j] for j in range(len(chunk))])[of]
                out["did"].append(pa.array(np.array(ids, dtype=np.int64)[doc]))
                out["part"].append(pa.array(np.full(len(doc), part)))
                out["text"].append(pa.array(np.array(known, dtype=np.int64)[doc]))
                out["at"].append(pa.array(low - a.starts[of]))
        return {k: pa.concat_arrays(v) for k, v in out.items()} if out["did"] else None

    return common.per_batch(rows.select("part", "did", "text"), step, schema, setup, ROWS)


def repeated(contexts: pa.Array, dids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, length) of what an earlier document's context has of distinct contexts with their first document: the union of repeats, by context."""
    offsets = np.frombuffer(contexts.buffers()[1], dtype=np.int32)[contexts.offset : contexts.offset + len(contexts) + 1].astype(np.int64)
    data = np.frombuffer(contexts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    own = SuffixArray(data, offsets[:-1], offsets[1:], SPAN)
    length, first, last = own.intervals(SPAN)
    if not len(length):
        return (np.empty(0, np.int64),) * 3
    n = last - first + 1
    ends = np.cumsum(n)
    place = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
    start = own.order[place]
    of = np.searchsorted(offsets, start, side="right") - 1
    earliest = np.minimum.reduceat(dids[of], ends - n)
    later = dids[of] > np.repeat(earliest, n)
    start, end = start[later], (start + np.repeat(length, n))[later]
    order = np.argsort(start, kind="stable")
    start, end, of = start[order] + of[later][order], end[order] + of[later][order], of[later][order]  # a gap of one keeps contexts apart
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(start) else np.empty(0, np.int64)
    last = np.concatenate([first[1:] - 1, [len(start) - 1]]) if len(first) else first
    return of[first], start[first] - of[first] - offsets[of[first]], reach[last] - start[first]


def _found(contexts: DataFrame, shards: int) -> DataFrame:
    """part, text, did, at, length: what is to be removed, from the contexts of whole anchors, some thousands at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            hashed, mark, did, at = (rows[x].to_numpy() for x in ("hash", "mark", "did", "at"))
            context = rows["context"].chunk(0) if rows["context"].num_chunks else pa.array([], pa.binary())
            size = np.asarray(pa.compute.binary_length(context)).astype(np.int64)
            same = pa.compute.equal(context.slice(1), context.slice(0, len(context) - 1)).to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], (np.diff(hashed) != 0) | (np.diff(mark) != 0) | ~same.astype(bool)])
            group = np.concatenate([[True], np.diff(hashed) != 0])
            distinct = np.flatnonzero(new)
            of_row = np.cumsum(new) - 1  # sorted by did within a context: its first row has the first document
            later = did > did[distinct][of_row]
            several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(group)) > 1
            mixed = distinct[several[np.cumsum(group) - 1][distinct]]
            which, offset, length = repeated(context.take(pa.array(mixed)), did[mixed]) if len(mixed) else (np.empty(0, np.int64),) * 3
            # The first document's rows take the repeats, others take the whole context.
            which = of_row[mixed[which]] if len(which) else which
            order = np.argsort(which, kind="stable")
            which, offset, length = which[order], offset[order], length[order]
            rest = np.flatnonzero(~later)
            low, high = np.searchsorted(which, of_row[rest]), np.searchsorted(which, of_row[rest], side="right")
            n = high - low
            ends = np.cumsum(n)
            pick = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - n), n)
            row = np.concatenate([np.flatnonzero(later), np.repeat(rest, n)])
            begin = np.concatenate([at[later], np.repeat(at[rest], n) + offset[pick]])
            long = np.concatenate([size[later], length[pick]])
            took = rows.select(["part", "text", "did"]).take(pa.array(row)).combine_chunks()
            return pa.RecordBatch.from_arrays([*(x.chunk(0) if x.num_chunks else pa.array([], pa.int64()) for x in took.columns), pa.array(begin), pa.array(long)], ["part", "text", "did", "at", "length"])

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if n >= BUFFER and (edge := int(np.searchsorted(np.asarray(batch["hash"]) != held[-1]["hash"][-1].as_py(), True))) < batch.num_rows:
                held.append(batch.slice(0, edge))
                yield of(pa.Table.from_batches(held))
                held, n, batch = [], 0, batch.slice(edge)
            held.append(batch)
            n += batch.num_rows
        if n:
            yield of(pa.Table.from_batches(held))

    rows = contexts.repartition(shards, "hash").withColumn("mark", F.xxhash64("context"))
    return rows.sortWithinPartitions("hash", "mark", "did").mapInArrow(run, "part long, text long, did long, at long, length long")


def _hot_found(windows: DataFrame) -> DataFrame:
    """part, text, did, at, length of the windows of hot anchors whose digest an earlier document has."""
    first = windows.groupBy("key").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last")
    first = first.select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    windows = windows.withColumn("salt", F.pmod(F.xxhash64("did", "at"), F.lit(SALTS)).cast("int"))
    return windows.join(first, ["key", "salt"]).where("did > first").select("part", "text", "did", "at", F.lit(SPAN).cast("long").alias("length"))


def _hot_anchors(rows: DataFrame) -> DataFrame:
    """hash, n of the anchors that shards name as hot."""
    def step(batch: dict) -> dict:
        found = [_unpacked(x, ["<i8", "<i8"]) for x in batch["body"].to_pylist()]
        return {"hash": np.concatenate([np.empty(0, np.int64), *(x for x, _ in found)]), "n": np.concatenate([np.empty(0, np.int64), *(x for _, x in found)])}

    return common.per_batch(rows.select("body"), step, "hash long, n long")


def merged(n: int, at: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """The spans' union within n bytes, as maximal runs."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    covered = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
    turns = np.diff(covered)
    return list(zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True))


def _kept(rows: DataFrame, found: str, copies: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (starts and ends in turn), kept."""
    def setup() -> tuple:
        return Answers(found, ["text", "did", "at", "length"], _by_row), _copies(copies)

    def step(batch: dict) -> dict:
        answers, copied = batch[""]
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "spans", "kept")}
        for part, start, end in _by_part(batch):
            (spans, at, length), gone = answers.of(part), copied.of(part)
            for x, did_ in zip(batch["text"].slice(start, end - start).to_pylist(), batch["did"].slice(start, end - start).to_pylist(), strict=True):
                key = (text_id(x), did_)
                runs = []
                if key in gone:
                    runs = [(0, len(x))] if len(x) >= SPAN else []
                elif key in spans:
                    a, b = spans[key]
                    runs = merged(len(x), at[a:b], length[a:b])
                kept, place = [], 0
                for a, b in runs:
                    kept.append(x[place:a])
                    place = b
                kept.append(x[place:])
                out["n_bytes"].append(len(x))
                out["n_removed"].append(sum(b - a for a, b in runs))
                out["n_spans"].append(len(runs))
                out["spans"].append([y for r in runs for y in r])
                out["kept"].append(b"".join(kept))
        return {"doc_id": batch["doc_id"], **out}

    return common.per_batch(rows, step, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary", setup, ROWS)


def removed(docs: DataFrame, scan: bool = False, hot: int = HOT, flush: int = FLUSH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept (the remaining bytes) of every document.

    `scan`: docs is a plain read of files, whose parts stay the same from read to read; anything else is written to the shared folder first.
    """
    spark = docs.sparkSession
    if not scan:
        docs = spark.read.parquet(common.stored(common.pick(docs, "doc_id", "text")))
    rows = parts_of(docs)
    # Copies: the digest's first eight bytes name a text to its own part; whether two texts are equal the whole digest tells.
    def slim(batch: dict) -> dict:
        digests = [hashlib.md5(x).digest() for x in batch["text"].to_pylist()]
        return {"part": batch["part"], "did": batch["did"], "digest": pa.array(digests, pa.binary()), "text": [int.from_bytes(x[:8], "little", signed=True) for x in digests], "size": pa.compute.binary_length(batch["text"])}

    digested = common.cut(common.per_batch(rows.select("part", "did", "text"), slim, "part long, did long, digest binary, text long, size long"))
    size = digested.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    first = digested.groupBy("digest").agg(F.min("did").alias("first"))
    copies = common.stored(digested.join(first, "digest").where("did > first").select("part", "text", "did").distinct(), "part")
    shared = common.stored(_shared(_sent(rows, shards, copies), shards, hot, flush), "part")
    told = common.cut(_hot_anchors(spark.read.schema("body binary, part long").parquet(shared).where(F.col("part") == HOTS)))
    least = max(hot, told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_ANCHORS)
    # Each has more than a ten-millionth of their places, so there are fewer than HOT_ANCHORS.
    large = spark.sparkContext.broadcast(told.where(F.col("n") > least).select("hash").toArrow()["hash"].to_numpy())
    found = _found(_contexts(rows, shared, copies, large, False), shards)
    if len(large.value):
        found = found.unionByName(_hot_found(_contexts(rows, shared, copies, large, True)))
    return _kept(rows, common.stored(found, "part"), copies)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed(common.table(spark, sf_dir, "documents"), scan=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: All windows of 50 bytes, in hexadecimal, with the first document of each; quick enough for small tables only.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, o, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT r, o, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
f AS (SELECT g, min(o) AS first, max(o) AS last FROM w GROUP BY g HAVING min(o) < max(o)),
m AS (SELECT r, i FROM w JOIN f USING (g) WHERE o > first),
s AS (SELECT *, CASE WHEN i <= 50 + max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM m),
p AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM s) GROUP BY r, span),
k AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS last FROM p),
x AS (SELECT k.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head, max(b) AS tail FROM k JOIN d USING (r) GROUP BY k.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * tail + 1), h))) AS kept_sha256 FROM d LEFT JOIN x USING (r)
"""
