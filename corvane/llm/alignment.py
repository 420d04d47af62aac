"""Alignment of two tokenizers' tokens by a dangling-suffix transducer, and how widely each pair of linked tokens is found.

Two token sequences of one text are read side by side. The state is which side leads and the bytes by which its last token sticks out;
the next token of the other side either is a beginning of these bytes, or takes them and leads itself. Transitions are kept by state
and token. Where nothing sticks out a group is closed, and each token read while something does is linked with the token that does.

Texts are cut before a space that follows a letter, digit or ASCII punctuation: no token of either vocabulary goes across such a place
(checked for the pieces when they are loaded; the other pattern's words never hold a space after anything else). So both libraries
and the transducer see each stretch once, and a worker keeps what the last `KEPT` to twice as many stretches came to.

Three passes. The first tokenises and writes, for each document, its digest of groups and its linked pairs with their numbers,
in compact form, to the shared folder, the documents of a task under one part. The second counts documents by pair: sums by part, then a
shuffle of these sums; what comes back to a part are the counts of its own pairs, in files by part. The third reads what the first has
written, and takes each document's sums from the part's counts. Nothing is held for the whole corpus at one place.

Defined results: null and empty texts, and texts that a vocabulary doesn't give back, have no tokens: zeros and an empty digest column.
Null ids and repeated rows are documents of their own. Further columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import bpe, common
from corvane.llm.repeats import _packed, _unpacked

KEPT, STEPS, CHUNK = 100_000, 1_000_000, 1 << 20
WIDTH = 16  # bits of a second token's id in a pair
#: Each stretch begins with a space that follows a letter, digit or ASCII punctuation, or with the text.
STRETCH = re.compile(r" [^ ]*(?:(?<![\w!-/:-@\[-`{-~]) [^ ]*)*")


class Transducer:
    """Transitions between dangling suffixes, each found when it is first met."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        self.tokens = (a, b)
        self.names = tuple([b"%d" % i for i in range(len(x))] for x in (a, b))
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.known: list[tuple[int, bytes]] = [(0, b"")]
        self.steps: dict[int, int] = {}
        self.single: dict[int, bytes] = {}

    def step(self, state: int, token: int) -> int:
        """The state after the lagging side's token (the first side's, where nothing dangles); -1 if its bytes don't fit."""
        key = state << 20 | token
        after = self.steps.get(key)
        if after is None:
            after = self.steps[key] = self._found(state, token)
        return after

    def _found(self, state: int, token: int) -> int:
        side, rest = self.known[state]
        if not state:
            new = (0, self.tokens[0][token])
        else:
            own = self.tokens[1 - side][token]
            if rest.startswith(own):
                new = (side, rest[len(own) :])
            elif own.startswith(rest):
                new = (1 - side, own[len(rest) :])
            else:
                return -1
        if not new[1]:
            return 0
        at = self.states.setdefault(new, len(self.known))
        if at == len(self.known):
            self.known.append(new)
        return at

    def aligned(self, a: list[int], b: list[int]) -> tuple[list[int], bytes] | None:
        """Linked pairs (first id << WIDTH | second id), and the groups as `a1,a2|b1;a3|b2,b3`; None if the bytes differ.

        A group begins with a token of each side. Where these two close it, that is kept by the pair, with the group's text."""
        if len(self.steps) > STEPS or len(self.single) > STEPS:
            self.clear()
        links, groups = [], []
        i, j, n, m = 0, 0, len(a), len(b)
        single, steps, known, (first, second) = self.single, self.steps, self.known, self.names
        while i < n and j < m:
            x, y = a[i], b[j]
            link = x << WIDTH | y
            links.append(link)
            text = single.get(link)
            if text is not None:
                groups.append(text)
                i += 1
                j += 1
                continue
            begin, start = i, j
            i += 1
            j += 1
            state = self.step(self.step(0, x), y)
            if not state:
                text = single[link] = first[x] + b"|" + second[y]
                groups.append(text)
                continue
            while state > 0:
                if known[state][0]:  # the second side leads
                    if i == n:
                        return None
                    x = token = a[i]
                    i += 1
                else:
                    if j == m:
                        return None
                    y = token = b[j]
                    j += 1
                links.append(x << WIDTH | y)
                after = steps.get(state << 20 | token)
                state = self.step(state, token) if after is None else after
            if state < 0:
                return None
            groups.append(b",".join([first[x] for x in a[begin:i]]) + b"|" + b",".join([second[y] for y in b[start:j]]))
        return None if i < n or j < m else (links, b";".join(groups))


class Aligner:
    """Both tokenizers, their tokens' bytes, and the stretches met lately: (pairs as 32-bit integers, groups, tokens of the first side << 32 | of the second)."""

    def __init__(self, body: str, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(body)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        code = {x: i for i, x in enumerate(bpe.byte_symbols())}
        vocabulary = self.a.get_vocab()
        first = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            first[i] = bytes(code[x] for x in token) if all(x in code for x in token) else token.encode()
        if not {bytes([x]) for x in range(256)} <= set(first):
            raise ValueError("a byte is no token")
        second = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if re.search("[^▁]▁", piece):
                raise ValueError(f"a piece goes across the start of a word: {piece!r}")
            second.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if len(first) > 1 << (32 - WIDTH) or len(second) > 1 << WIDTH:
            raise ValueError("a pair of ids does not fit 32 bits")
        self.space = self.b.piece_to_id("▁")
        self.plain = _ranked(json.loads(body), {x: i for i, x in enumerate(first)})
        self.transducer = Transducer(first, second)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.rare: dict[str, tuple | None] = {}

    def first(self, stretches: list[str]) -> list[list[int]]:
        """Ids of the first tokenizer."""
        out = [self.plain(x) if self.plain and PLAIN(x) else None for x in stretches]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.a.encode_batch_fast([stretches[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def second(self, stretches: list[str]) -> list[list[int]]:
        """Ids of the second; it puts a space before a text itself, but not before an empty one."""
        out = self.b.encode([x[1:] for x in stretches], num_threads=1)
        return [[self.space] if x == " " else y for x, y in zip(stretches, out, strict=True)]

    def learn(self, stretches: set[str]) -> None:
        """What these stretches, not among the young, come to; those of common length are kept, others till the next call."""
        young, old, rare, aligned = self.young, self.old, {}, self.transducer.aligned
        new = []
        for x in stretches:
            if x in old:
                young[x] = old[x]
            else:
                new.append(x)
        for x, a, b in zip(new, self.first(new), self.second(new), strict=True):
            found = aligned(a, b)
            if found is None:
                rare[x] = None
            else:
                value = np.array(found[0], "<u4").tobytes() if len(found[0]) > 60 else struct.pack(f"<{len(found[0])}I", *found[0]), found[1], len(a) << 32 | len(b)
                if len(x) <= 64:
                    young[x] = value
                else:
                    rare[x] = value
        self.rare = rare


#: Stretches of letters, digits and ASCII signs of which all versions of Unicode's tables say the same.
PLAIN = re.compile(r"[\t\n !-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*").fullmatch
#: Fixed: the byte-level pattern of words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(whole: dict, ids: dict[bytes, int]):
    """A faster encoder of the same vocabulary for plain stretches: its ids are ranks, so it is taken only where merges are numbered in order."""
    import tiktoken

    step = whole["pre_tokenizer"]
    vocabulary = whole["model"]["vocab"]
    merged = [vocabulary["".join(x.split(" ") if isinstance(x, str) else x)] for x in whole["model"]["merges"]]
    if whole["normalizer"] or step != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or merged != sorted(merged) or min(merged) < 256:
        return None
    special = {x["id"] for x in whole["added_tokens"]}
    ranks = {x: i for x, i in ids.items() if i not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


@functools.lru_cache(maxsize=1)
def aligner(body: str, pieces: bytes) -> Aligner:
    """One aligner for all tasks of a worker."""
    return Aligner(body, pieces)


def documents(texts: list[str | None], own: Aligner) -> Iterator[dict]:
    """For each text n_a, n_b, n_groups, n_links, groups_sha256, and its pairs (sorted) with their numbers."""
    none = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": np.empty(0, "<u4"), "times": np.empty(0, "<u4")}
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (size == 0 or size + len(texts[end] or "") <= CHUNK):
            size += len(texts[end] or "")
            end += 1
        cut = [STRETCH.findall(" " + x) if x else [] for x in texts[start:end]]
        if len(own.young) >= KEPT:
            own.old, own.young = own.young, {}
        young = own.young
        own.learn(set().union(*(set(row).difference(young) for row in cut)))
        get, rare = young.get, own.rare
        for row in cut:
            found = [get(x) or rare[x] for x in row]
            if not found or None in found:
                yield none
                continue
            links, groups, tokens = zip(*found, strict=True)
            groups, tokens = b";".join(groups), sum(tokens)
            links = np.frombuffer(b"".join(links), "<u4")
            pairs, times = np.unique(links, return_counts=True)
            yield {
                "n_a": tokens >> 32, "n_b": tokens & 0xFFFFFFFF, "n_groups": groups.count(b";") + 1, "n_links": len(links),
                "groups_sha256": hashlib.sha256(groups).hexdigest(), "pairs": pairs, "times": times.astype("<u4"),
            }
        start = end


SUMS = ("n_a", "n_b", "n_groups", "n_links")
CODED = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, body binary"


def coded(docs: DataFrame, a: str, b: str) -> DataFrame:
    """part (one for each task), doc_id, sums, groups_sha256, body (pairs and their numbers) of every document."""
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def setup() -> tuple[Aligner, int]:
        return aligner(*files.value), uuid.uuid4().int >> 65

    def step(batch: dict) -> dict:
        own, part = batch[""]
        rows = list(documents(batch["text"].to_pylist(), own))
        out = {k: [x[k] for x in rows] for k in (*SUMS, "groups_sha256")}
        bodies = pa.array([_packed([np.diff(x["pairs"], prepend=np.uint32(0)), x["times"]]) for x in rows], pa.binary())
        return {"part": np.full(len(rows), part), "doc_id": batch["doc_id"], **out, "body": bodies}

    own = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return common.per_batch(own, step, CODED, setup, 2000)


def _pairs(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, times = _unpacked(body, ["<u4", "<u4"])
    return np.cumsum(steps, dtype=np.uint32), times


def counted(rows: DataFrame) -> DataFrame:
    """part, pair, docs, best: of each pair of a part, in how many documents of the corpus it is linked, and whether no other pair of its
    first token is in more. A pair has a row for each part and batch before the sums; a first token, one for each second token at most."""
    def step(batch: dict) -> dict:
        part, bodies = np.asarray(batch["part"]), batch["body"].to_pylist()
        out: dict[str, list] = {"part": [np.empty(0, np.int64)], "pair": [np.empty(0, np.int64)], "n": [np.empty(0, np.int64)]}
        for at in np.unique(part):
            pair, n = np.unique(np.concatenate([_pairs(bodies[i])[0] for i in np.flatnonzero(part == at)]), return_counts=True)
            for k, v in zip(out, (np.full(len(pair), at), pair.astype(np.int64), n), strict=True):
                out[k].append(v)
        return {k: np.concatenate(v) for k, v in out.items()}

    parts = common.per_batch(rows.select("part", "body"), step, "part long, pair long, n long").groupBy("part", "pair").agg(F.sum("n").alias("n"))
    parts = common.cut(parts)
    totals = parts.groupBy("pair").agg(F.sum("n").alias("docs"))
    totals = totals.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy(F.shiftright("pair", WIDTH))))
    return parts.select("part", "pair").join(totals, "pair")


def alignments(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    first = common.stored(coded(docs, a or bpe.tokenizer_file("byte_bpe_50k.json"), b or bpe.tokenizer_file("piece_bpe_32k.model")))
    rows = spark.read.schema(CODED).parquet(first)
    told = common.stored_by_part(counted(rows))

    def setup() -> common.PartTable:
        return common.PartTable(told, ["pair", "docs", "best"])

    def step(batch: dict) -> dict:
        part, bodies = np.asarray(batch["part"]), batch["body"].to_pylist()
        best, total = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for at in np.unique(part):
            table = batch[""].of(int(at))
            if table is None:
                continue
            pair, docs_, top = (table[x].to_numpy() for x in ("pair", "docs", "best"))
            order = np.argsort(pair)
            pair, docs_, top = pair[order], docs_[order], top[order]
            for i in np.flatnonzero(part == at).tolist():
                own, times = _pairs(bodies[i])
                place = np.searchsorted(pair, own)
                best[i], total[i] = (top[place] * times.astype(np.int64)).sum(), (docs_[place] * times.astype(np.int64)).sum()
        return {**{k: batch[k] for k in ("doc_id", *SUMS, "groups_sha256")}, "n_best": best, "count_sum": total}

    return common.per_batch(rows, step, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string", setup)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(common.table(spark, sf_dir, "documents"))
