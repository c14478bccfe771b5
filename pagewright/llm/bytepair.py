"""Byte-pair encoding by a pair occurrence index (operator 1), and the shared vocabulary files.

Method: the words of a partition's slice are laid out in one symbol array with
links to the neighbours. An index maps each mergeable pair to all positions where
it occurs. The active ranks are taken in ascending order from a heap; one step
merges every position of that pair at once and puts the pairs that arise at the
touched positions into the lists of their own ranks.

Defined results for odd input: null text counts as empty (no ids); an empty table
gives an empty result; repeated rows give repeated results; a text of any length is
processed whole; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm._scratch import kept, slices

#: Entries a worker keeps of what it knows about units before it starts anew.
CACHE_UNITS = 600_000
#: Longer units are not kept.
LONG_UNIT = 256

_UNIT = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACES = re.compile(rb"[ \t-\r] ")
#: Basic Latin, Latin-1 and Latin Extended-A, where every table of letters agrees.
_PLAIN_LETTERS = re.compile("[\x00-\u017f]*")
_ODD_UNIT = regex.compile(r"\s*\S+|\s+")
_BYTE_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class PairIndex:
    """Merges of a vocabulary, and encoding of many words at once by ascending rank."""

    BASE = 1 << 20

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        chars = byte_chars()
        self.suffix = suffix
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        # the suffix belongs to the right part alone, so joining the strings gives the merged token
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self.BASE + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where the pair never merges."""
        key = a.astype(np.int64) * self.BASE + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words in a row, and how many each word has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.concatenate(([0], ends[:-1]))
        n = len(data)
        sym = self.first[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[starts] = n, n
        alive = np.ones(n + 1, bool)
        sym = np.append(sym, -1)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(heads: np.ndarray) -> None:
            """Put the pairs that start at these positions into the lists of their ranks."""
            ranks = self.ranks(sym[heads], sym[after[heads]])
            found = ranks >= 0
            heads, ranks = heads[found], ranks[found]
            if not len(heads):
                return
            order = np.argsort(ranks, kind="stable")
            heads, ranks = heads[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(heads, cuts), strict=True):
                if rank not in lists:
                    lists[rank] = [part]
                    heapq.heappush(heap, rank)
                else:
                    lists[rank].append(part)

        index(np.flatnonzero(after[:n] != n))
        while heap:
            rank = heapq.heappop(heap)
            held = lists.pop(rank)
            at = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
            a, b = self.left[rank], self.right[rank]
            to = after[at]
            good = alive[at] & (sym[at] == a) & (sym[to] == b)
            at, to = at[good], to[good]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # of a run of equal symbols every second pair, from the left
                run = np.concatenate(([True], to[:-1] != at[1:]))
                place = np.arange(len(at))
                keep = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
                at, to = at[keep], to[keep]
            sym[at], sym[to], alive[to] = self.made[rank], -1, False
            right = after[to]
            after[at] = right
            before[right] = at
            left = before[at]
            index(np.concatenate((left[left != n], at[right != n])))
        return sym[:n][alive[:n]], np.add.reduceat(alive[:n].astype(np.int64), starts)


class Vocabulary:
    """A tokenizer file: how texts split into units and units into words, and the pair index."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        self.suffix = model.get("end_of_word_suffix") or ""
        self.index = PairIndex(model["vocab"], model["merges"], self.suffix)
        self.added = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self._added = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + b")") if self.added else None
        back = {c: b for b, c in enumerate(byte_chars())}
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            end = bool(self.suffix) and token.endswith(self.suffix)
            raw = bytes(back[c] for c in (token[: -len(self.suffix)] if end else token))
            self.token_bytes[i] = raw + b" " * end
        for raw, i in self.added.items():
            self.token_bytes[i] = raw
        library = Tokenizer.from_file(path)
        self._normal, self._split, self._back = library.normalizer, library.pre_tokenizer, back
        self._words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) if self.suffix else _BYTE_WORDS

    def units(self, text: bytes) -> list[bytes]:
        """Keys of parts whose encodings, one after the other, are the encoding of the text.

        A key of a byte-level vocabulary stands for a space and itself, or after the byte
        0xFF (which no UTF-8 text has) for the rest of it; :meth:`raw` gives the part.
        """
        if self._added and self._added.search(text):
            return [u for part in self._added.split(text) if part for u in ([b"\xff" + part] if part in self.added else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: bytes) -> list[bytes]:
        if self.suffix:
            return text.split()  # ASCII white space is dropped by this kind of tokenizer
        if not text.isascii() and _ODD_SPACE.search(text):
            return [b"\xff" + u.encode() for u in _ODD_UNIT.findall(text.decode())]
        if not text or text[-1:] == b" " or _SPACES.search(text):
            return [b"\xff" + u for u in _UNIT.findall(text)]
        keys = text.split(b" ")  # single spaces alone: each begins a part
        if keys[0]:
            keys[0] = b"\xff" + keys[0]
        else:
            del keys[0]
        return keys

    def raw(self, key: bytes) -> bytes:
        """The bytes of text that a key stands for."""
        return key[1:] if key[:1] == b"\xff" else key if self.suffix else b" " + key

    def words(self, unit: bytes) -> list[bytes]:
        """The words (each merged on its own) of a part that is no added token."""
        text = unit.decode()
        if text.isascii():
            return [w.encode() for w in self._words.findall(text.lower() if self.suffix else text)]
        if self.suffix:
            text = self._normal.normalize_str(text)
        if _PLAIN_LETTERS.fullmatch(text):
            return [w.encode() for w in self._words.findall(text)]
        # the library's own tables of letters for what is outside Latin
        return [bytes(map(self._back.__getitem__, w)) for w, _ in self._split.pre_tokenize_str(text)]

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units (given as keys) in a row, and the bounds of each unit's ids (one more than units)."""
        place: dict[bytes, int] = {}
        order, sizes = [], []
        for key in units:
            raw = self.raw(key)
            if raw in self.added:
                own = [raw]
            else:
                own = self.words(raw)
            sizes.append(len(own))
            for w in own:
                order.append(place.setdefault(w, len(place)))
        special = {w: i for w, i in place.items() if w in self.added}
        ids, counts = self.index.encode(list(place))
        starts = np.cumsum(counts) - counts
        if special:  # an added token is one id
            ids = ids.copy()
            for w, i in special.items():
                ids[starts[i]], counts[i] = self.added[w], 1
        at = np.array(order, np.int64)
        n = counts[at] if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = ids[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])] if len(at) else ids
        return flat, ends[np.cumsum([0, *sizes])]


_HELD: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each worker."""
    if path not in _HELD:
        _HELD[path] = Vocabulary(path)
    return _HELD[path]


class UnitCache:
    """What a worker knows about units. ``learn(units)`` computes entries for new ones, in one go."""

    def __init__(self, learn, limit: int = CACHE_UNITS):
        self.learn, self.limit, self.known = learn, limit, {}

    def get(self, lists: list[list[bytes]]) -> dict:
        """A mapping that has every unit of the lists."""
        seen = set().union(*lists)
        new = [u for u in seen if u not in self.known]
        if len(self.known) + len(new) > self.limit:  # what this slice has as well stays
            self.known = {u: self.known[u] for u in seen if u in self.known}
        if not new:
            return self.known
        made = dict(zip(new, self.learn(new), strict=True))
        long = [u for u in new if len(u) > LONG_UNIT]
        if not long:
            self.known.update(made)
            return self.known
        out = self.known | made
        self.known.update((u, e) for u, e in made.items() if len(u) <= LONG_UNIT)
        return out


def unit_cache(kind: str, path: str, learn, limit: int = CACHE_UNITS) -> UnitCache:
    """The worker's cache of one kind for one vocabulary."""
    return kept((kind, path), lambda: UnitCache(learn, limit))


def _digest_learner(vocab: Vocabulary):
    decimal = [str(i).encode() for i in range(len(vocab.token_bytes))]

    def learn(units: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
        ids, ends = vocab.encode_units(units)
        ids, ends = ids.tolist(), ends.tolist()
        for key, s, e in zip(units, ends, ends[1:], strict=False):
            own = ids[s:e]
            raw = b"".join([vocab.token_bytes[i] for i in own])
            yield e - s, b",".join([decimal[i] for i in own]), key if raw == key else raw

    return learn


def bpe_digest(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both.

    Columns: the id, n_tokens, ids_sha256, decoded_sha256, round_trip (the decoded
    text is the text). Map only: no shuffle, memory bounded by a slice of texts or
    one text and the unit cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        cache = unit_cache("digest", vocab_path, _digest_learner(vocab))
        for batch in batches:
            for part, texts in slices(batch, 1):
                lists = [vocab.units(t) for t in texts]
                known = cache.get(lists)
                n, ids, decoded, same = [], [], [], []
                for text, units in zip(texts, lists, strict=True):
                    own = [x for x in map(known.__getitem__, units) if x[0]]
                    counts, decimals, raws = zip(*own, strict=True) if own else ((), (), ())
                    raw = b"".join(raws).decode("utf-8", "replace").encode()
                    n.append(sum(counts))
                    ids.append(hashlib.sha256(b",".join(decimals)).hexdigest())
                    decoded.append(hashlib.sha256(raw).hexdigest())
                    same.append(raw == text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def _ids_learner(vocab: Vocabulary):
    def learn(units: list[bytes]) -> Iterator[list[int]]:
        ids, ends = vocab.encode_units(units)
        ids, ends = ids.tolist(), ends.tolist()
        return (ids[s:e] for s, e in zip(ends, ends[1:], strict=False))

    return learn


def bpe_encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``ids`` (array of int) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        cache = unit_cache("ids", vocab_path, _ids_learner(vocab))
        for batch in batches:
            for part, texts in slices(batch, 1):
                lists = [vocab.units(t) for t in texts]
                known = cache.get(lists)
                ids = [[i for u in units for i in known[u]] for units in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and ``text`` of every row of ids; null ids give an empty text, ids outside the vocabulary are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(vocab_path).token_bytes
        for batch in batches:
            texts = [b"".join([table[i] for i in ids or () if i is not None and 0 <= i < len(table)]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col).cast("array<bigint>")).mapInArrow(run, f"`{id_col}` {kind}, text string")
