"""BPE encoding and decoding with a public tokenizer file, a segment tree over adjacent pair ranks choosing the merges.

A word's symbols stand in a row; a leaf of the tree holds the rank of the pair that starts at its symbol, with the place to
break ties, and an inner node the least of its two. The root thus yields the leftmost pair of the lowest rank; a merge rewrites
two or three leaves and their paths. The tree is used until the root holds no pair, so a word of n symbols takes n log n steps.
Words of like length have their trees side by side in one array, where a step makes one merge of each; the few that are longer than
others have a tree of their own.

The file's own steps come first: its two special strings are cut out of the raw text, what is between is composed (NFC),
lower-cased by character, and split into words; a word's UTF-8 bytes are its symbols, the last one marked as the word's end.
What stands between blanks recurs, so each worker keeps the ids of the last `KEPT` to twice as many such pieces, and a slab of texts
looks its pieces up at once: only those not met lately are cut into words and merged. Python's Unicode tables and the library's are of
different versions: the driver compares the two over all code points, and a text with one that they treat differently takes its
normal form and its words from the library's normalizer and splitter; merges are made here all the same. The file's content is
broadcast, so workers need no path of the driver's. Nothing is shuffled.

Defined results: a null text is an empty one, with no tokens and the empty string decoded. Repeated rows and null ids give
rows of their own. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common

KEPT = 200_000
#: Characters of the pieces looked up at once, and of a text cut into pieces at once.
SLAB, STRETCH = 1 << 20, 1 << 20
#: Leaves of trees side by side at most; words of a length that are too few for it.
LEAVES, FEW = 1 << 19, 8
NONE = 1 << 62
#: Fixed: the white space of the file's patterns, what str.split() takes for white space besides, and the file's pattern of words.
BLANK = "\t-\r \x85\xa0  -     　"
CONTROLS = "\x1c\x1d\x1e\x1f"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it is printable in Latin-1, else the next free code from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [rest.get(b, chr(b)) for b in range(256)]


def normal(text: str) -> str:
    """A text's normal form, by Python's tables."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def words(text: str) -> list[str]:
    """A text's words in normal form, by Python's tables."""
    return WORDS.findall(normal(text))


class Library:
    """The file's normalizer and splitter as the library runs them."""

    def __init__(self, whole: dict) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        split = next(x for x in whole["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        bare = Tokenizer(models.BPE())
        self.normalizer = Tokenizer.from_str(json.dumps(json.loads(bare.to_str()) | {"normalizer": whole["normalizer"]})).normalizer

    def words(self, text: str) -> list[str]:
        return [x for x, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]


def _ranges(points: list[int]) -> tuple[tuple[int, int], ...]:
    """Code points as ranges, both ends included."""
    out: list[list[int]] = []
    for x in points:
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return tuple((a, b) for a, b in out)


@lru_cache(maxsize=2)
def strange_points(body: str) -> tuple[tuple[int, int], ...]:
    """Ranges of the code points whose class, case or normal form Python and the library may see differently: those found to differ
    beside letters, digits and accents or in a decomposed pair, and all that Python's tables don't know."""
    library = Library(json.loads(body))
    shapes = ("{0}", "a{0}b1", "A{0}\u0301", "e\u0323{0}", "o\u0301{0}\u0323 ")
    unknown, known = [], []
    for x in chain(range(0x80, 0xD800), range(0xE000, 0x110000)):
        (unknown if unicodedata.category(chr(x)) == "Cn" else known).append(x)
    # Letters of the large uniform blocks, and private use, are alike but for what stands at their ends.
    plain = ((0x3500, 0x4D00), (0x4F00, 0x9F00), (0xAD00, 0xD700), (0xE100, 0xF800), (0x20100, 0x2A600), (0x2A800, 0x2B700), (0x2B900, 0x2CE00), (0x2CF00, 0x2EB00), (0x30100, 0x31300), (0x31400, 0x32300), (0xF0100, 0xFFF00), (0x100100, 0x10FF00))
    tried = [(x, [f.format(chr(x)) for f in shapes]) for x in known if not any(a <= x < b for a, b in plain)]
    for x, _ in list(tried):
        parts = unicodedata.decomposition(chr(x)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            tried += [(int(y, 16), [chr(int(parts[0], 16)) + chr(int(parts[1], 16))]) for y in parts]
    found = set(unknown)
    todo = [tried[i : i + 256] for i in range(0, len(tried), 256)]
    while todo:
        some = todo.pop()
        text = "\n".join(y for _, forms in some for y in forms)
        if words(text) != library.words(text):
            if len(some) == 1:
                found.add(some[0][0])
            else:
                todo += [some[: len(some) // 2], some[len(some) // 2 :]]
    return _ranges(sorted(found))


class Vocabulary:
    """Pairs with rank and result, symbols of bytes, tokens by id, and the ids of pieces seen."""

    def __init__(self, body: str, strange: tuple[tuple[int, int], ...]) -> None:
        whole = json.loads(body)
        self.strange = np.zeros(0x110000, bool)
        for a, b in strange:
            self.strange[a : b + 1] = True
        self.library = Library(whole)
        model, ids = whole["model"], whole["model"]["vocab"]
        self.mark = model["end_of_word_suffix"] or ""
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.keys, self.ranks, self.results = self._table()
        self.inner = [ids[x] for x in byte_symbols()]
        self.last = [ids[x + self.mark] for x in byte_symbols()]
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of pairs in order, beside them their ranks; results by rank."""
        found = sorted(((a << 32) + b, rank) for (a, b), (rank, _) in self.pairs.items())
        keys, ranks = np.array([*found, (NONE, 0)], np.int64).T.copy()
        results = np.zeros(1 + max(rank for rank, _ in self.pairs.values()), np.int64)
        for rank, made in self.pairs.values():
            results[rank] = made
        return keys, ranks, results

    def leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of the pairs of symbols (-1: none) that start at these places."""
        wanted = (a << 32) + b
        found = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[found] == wanted, self.ranks[found] << 32 | at, NONE)

    def merged_all(self, raw: list[bytes]) -> Iterator[bytes]:
        """Ids of words of more than half of 2^k bytes, and 2^k at most, by trees side by side."""
        sizes = np.array([len(x) for x in raw])
        rows, width = len(raw), 1 << (int(sizes.max()) - 1).bit_length()
        # One place more than leaves stands for what is before the first symbol and after the last.
        span = width + 1
        symbols = np.full((rows, span), -1, np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols[np.arange(span) < sizes[:, None]] = np.array(self.inner)[data]
        symbols[np.arange(rows), sizes - 1] = np.array(self.last)[data[np.cumsum(sizes) - 1]]
        tree = np.full((rows, 2 * width), NONE, np.int64)
        tree[:, width:] = self.leaves(symbols[:, :-1], symbols[:, 1:], np.arange(width))
        at = width
        while at > 1:
            np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2], out=tree[:, at // 2 : at])
            at //= 2
        after = np.tile(np.arange(1, span + 1), (rows, 1))
        before = np.tile(np.arange(-1, width), (rows, 1))
        before[:, 0] = width
        symbols, tree, after, before = symbols.ravel(), tree.ravel(), after.ravel(), before.ravel()
        live = np.arange(rows)
        while True:
            root = tree[live * (2 * width) + 1]
            some = root != NONE
            if not some.all():
                live, root = live[some], root[some]
            if not len(live):
                break
            base, top = live * span, live * (2 * width)
            i = root & 0xFFFFFFFF
            j = after[base + i]
            k, h = after[base + j], before[base + i]
            made = self.results[root >> 32]
            symbols[base + i], symbols[base + j] = made, -1
            after[base + i], before[base + k] = k, i
            tree[top + width + j] = NONE
            tree[top + width + i] = self.leaves(made, symbols[base + k], i)
            # A first symbol has none before it, and j's leaf is empty already.
            first = h == width
            tree[top + width + np.where(first, j, h)] = np.where(first, NONE, self.leaves(symbols[base + h], made, h))
            paths = width + np.stack([j, i, np.where(first, j, h)])
            while paths[0, 0] > 1:
                paths >>= 1
                two = top + 2 * paths
                tree[top + paths] = np.minimum(tree[two], tree[two + 1])
        symbols = symbols.reshape(rows, span)
        kept = symbols >= 0
        ids = symbols[kept].astype("<u4").tobytes()
        ends = np.cumsum([0, *kept.sum(1)]) * 4
        return (ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def merged(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        pairs = self.pairs
        if n == 1:
            return symbols
        width = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * width)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if found := pairs.get((symbols[i], symbols[i + 1])):
                tree[width + i] = found[0] << 32 | i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int) -> None:
            j = after[i]
            found = pairs.get((symbols[i], symbols[j])) if j < n else None
            at, value = width + i, found[0] << 32 | i if found else NONE
            tree[at] = value
            while at > 1:
                a, b = tree[at], tree[at ^ 1]
                at >>= 1
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least

        while (root := tree[1]) != NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            symbols[i] = pairs[symbols[i], symbols[j]][1]
            symbols[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j) if j < n - 1 and tree[width + j] != NONE else None
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [x for x in symbols if x >= 0]

    def _words(self, found: Iterable[str]) -> dict[str, bytes]:
        """Ids of different words."""
        out: dict[str, bytes] = {}
        alike: dict[int, list[tuple[str, bytes]]] = {}
        for x in found:
            raw = x.encode()
            alike.setdefault((len(raw) - 1).bit_length(), []).append((x, raw))
        for size, some in alike.items():
            if len(some) < FEW or 1 << size > LEAVES:
                for x, raw in some:
                    out[x] = np.array(self.merged([self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]), dtype="<u4").tobytes()
                continue
            step = max(1, LEAVES >> size)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                out.update(zip([x for x, _ in part], self.merged_all([raw for _, raw in part]), strict=True))
        return out

    def _encoded(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of different pieces."""
        letters = {x for x in pieces if x.isascii() and x.isalpha()}
        out, cuts = {}, {}
        for x in pieces:
            if x[0] == "\n":
                out[x] = np.array([self.special[x[1:]]], dtype="<u4").tobytes()
            elif x not in letters:
                cuts[x] = (x[1:],) if x[0] == " " else tuple(WORDS.findall(x))
        ids = self._words(letters.union(*cuts.values()))
        out.update((x, ids[x]) for x in letters)
        out.update((x, b"".join([ids[w] for w in some])) for x, some in cuts.items())
        return out

    def _plain(self, text: str) -> Iterator[list[str]]:
        if not text.isascii() and self.strange[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            yield [" " + x for x in self.library.words(text)]
            return
        text, at = normal(text), 0
        odd = any(x in text for x in CONTROLS)
        while at < len(text):
            end = text.find(" ", at + STRETCH)
            part = text[at : end if end >= 0 else len(text)]
            yield [" " + x for x in WORDS.findall(part)] if odd else part.split()
            at += len(part)

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """A text's pieces in normal form, by stretches: what stands between blanks; where that can't be told by split(), words, behind a
        blank; special strings, behind a line end."""
        at = 0
        for cut in self.cuts.finditer(text) if any(x in text for x in self.special) else ():
            yield from self._plain(text[at : cut.start()])
            yield ["\n" + cut[0]]
            at = cut.end()
        yield from self._plain(text[at:])

    def _look_up(self, held: list[tuple[list[bytes], list[str]]]) -> None:
        """Adds the ids of pieces to their texts' parts; of the pieces kept, those not met since the last change of generation go first."""
        different = set().union(*(some for _, some in held)).difference(self.young)
        again = {x: self.old[x] for x in different if x in self.old}
        self.young.update(again)
        made = self._encoded(different.difference(again))
        self.young.update(made)
        for out, some in held:
            out.append(b"".join(map(self.young.__getitem__, some)))
        for x in made:
            if len(x) > 64:
                del self.young[x]
        if len(self.young) > KEPT:
            self.old, self.young = self.young, {}

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[bytes]] = []
        held: list[tuple[list[bytes], list[str]]] = []
        n = 0
        for text in texts:
            parts.append([])
            for some in self._pieces(text):
                held.append((parts[-1], some))
                n += sum(map(len, some))
                if n >= SLAB:
                    self._look_up(held)
                    held, n = [], 0
            if not held:
                yield from map(b"".join, parts)
                parts = []
        self._look_up(held)
        yield from map(b"".join, parts)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: tokens joined by spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


_MADE: dict[str, Vocabulary] = {}


def vocabulary(body: str, strange: tuple[tuple[int, int], ...]) -> Vocabulary:
    """One vocabulary for all tasks of a worker."""
    key = hashlib.md5(body.encode()).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Vocabulary(body, strange)
    return _MADE[key]


def loader(docs: DataFrame, path: str | None):
    """What a task calls for the vocabulary; the file is read on the driver and broadcast."""
    with open(path or tokenizer_file(), encoding="utf-8") as f:
        body = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((body, strange_points(body)))
    return lambda: vocabulary(*shared.value)


def _texts(docs: DataFrame) -> DataFrame:
    return common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids of every document."""
    def step(batch: dict) -> dict:
        own = batch[""]
        found = list(own.encode_all(x.as_py() for x in batch["text"]))
        ends = np.cumsum([0, *(len(x) // 4 for x in found)])
        return {"doc_id": batch["doc_id"], "n_tokens": np.diff(ends), "ids": common.lists(ends, np.frombuffer(b"".join(found), dtype="<u4").astype(np.int32))}

    return common.per_batch(_texts(docs), step, "doc_id long, n_tokens long, ids array<int>", loader(docs, path))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows with ids; null ids give the empty text."""
    def step(batch: dict) -> dict:
        own = batch[""]
        return {"doc_id": batch["doc_id"], "text": [own.decode(x.as_py() or []) for x in batch["ids"]]}

    return common.per_batch(common.pick(encoded, "doc_id", "ids"), step, "doc_id long, text string", loader(encoded, path))


def coded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, decoded: what encode() and decode() give of every document, in one row."""
    def step(batch: dict) -> dict:
        own = batch[""]
        found = [np.frombuffer(x, dtype="<u4") for x in own.encode_all(x.as_py() for x in batch["text"])]
        ends = np.cumsum([0, *map(len, found)])
        ids = common.lists(ends, np.concatenate([np.empty(0, "<u4"), *found]).astype(np.int32))
        return {"doc_id": batch["doc_id"], "n_tokens": np.diff(ends), "ids": ids, "decoded": [own.decode(x.tolist()) for x in found]}

    return common.per_batch(_texts(docs), step, "doc_id long, n_tokens long, ids array<int>, decoded string", loader(docs, path), 2000)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() and decode() give, digested where it is made."""
    def step(batch: dict) -> dict:
        own = batch[""]
        n, ids, decoded = [], [], []
        for raw in own.encode_all(x.as_py() for x in batch["text"]):
            n.append(len(raw) // 4)
            ids.append(hashlib.sha256(raw).hexdigest())
            decoded.append(hashlib.sha256(own.decode(np.frombuffer(raw, dtype="<u4").tolist()).encode()).hexdigest())
        return {"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(decoded)}

    return common.per_batch(_texts(docs), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", loader(docs, path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
