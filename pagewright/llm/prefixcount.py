"""Token counts at every prefix by dynamic programming (operator 4).

Method: the encoding of a prefix ends with the one token that may follow the last
token of the prefix before it. So for each end of a word, in order, the shortest
suffix that is a token and may stand after what is stored for the rest gives the
last token and the count of that prefix. Two tokens may stand side by side if no
merge across their border comes before the merges that build them.

From the stored counts follow the count of any prefix of a text, whether it fits a
budget, and where to cut it for one, without encoding anything again.

Defined results for odd input: null text counts as empty (0 bytes, 0 tokens, within
any budget); an empty table gives an empty result; repeated rows give repeated
results; texts of any length are processed whole; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._scratch import slices
from pagewright.llm.bytepair import Vocabulary, unit_cache, vocabulary

#: Entries of the table of token borders and of words that a worker keeps.
BORDERS = 1_000_000
WORDS = 300_000
_LEAD = regex.compile(r"\s*")
_SHORTENED = re.compile("'(?:re|ve|ll)")


class PrefixCounter:
    """Counts of a byte-level vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, index = vocab, vocab.index
        self.merge = {(a, b): r for r, (a, b) in enumerate(zip(index.left.tolist(), index.right.tolist(), strict=True))}
        built = dict(zip(index.made.tolist(), range(len(index.made)), strict=True))
        left, right = index.left.tolist(), index.right.tolist()
        never = len(left)
        special = set(vocab.added.values())
        plain = [i for i, raw in enumerate(vocab.token_bytes) if raw and i not in special]
        ids, counts = index.encode([vocab.token_bytes[i] for i in plain])
        ends = counts.cumsum()
        self.token = {vocab.token_bytes[i]: i for i, n, at in zip(plain, counts.tolist(), (ends - 1).tolist(), strict=True) if n == 1 and ids[at] == i}
        self.longest = max(map(len, self.token))

        def spine(i: int, side: list[int]) -> list[tuple[int, int]]:
            """The tokens at one edge of a token while it is built, and the rank that ends each."""
            out, until = [], never
            while True:
                out.append((i, until))
                if i not in built:
                    return out
                until = built[i]
                i = side[until]

        self._tail = lambda i: spine(i, right)
        self._head = lambda i: spine(i, left)
        self._tails: dict[int, list] = {}
        self._heads: dict[int, list] = {}
        self.borders: dict[int, bool] = {}
        self.words: dict[bytes, list[int]] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' text is the two tokens."""
        tails = self._tails.get(a) or self._tails.setdefault(a, self._tail(a))
        heads = self._heads.get(b) or self._heads.setdefault(b, self._head(b))
        merge = self.merge
        for x, until in tails:
            for y, end in heads:
                r = merge.get((x, y))
                # of equal ranks the left one merges first
                if r is not None and r < until and r <= end:
                    return False
        return True

    def word(self, word: bytes) -> list[int]:
        """Token counts of the word's prefixes of 0, 1, ... bytes."""
        held = self.words.get(word)
        if held is not None:
            return held
        token, borders, longest = self.token, self.borders, self.longest
        last, counts = [-1], [0]
        for i in range(1, len(word) + 1):
            for s in range(i - 1, max(-1, i - longest - 1), -1):
                t = token.get(word[s:i])
                if t is None:
                    continue
                if s:
                    key = last[s] << 20 | t
                    fits = borders.get(key)
                    if fits is None:
                        if len(borders) >= BORDERS:
                            borders.clear()
                        fits = borders[key] = self.may_follow(last[s], t)
                    if not fits:
                        continue
                last.append(t)
                counts.append(counts[s] + 1)
                break
        if len(word) <= 64:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = counts
        return counts

    def unit(self, key: bytes) -> int:
        """Tokens of a unit."""
        raw = self.vocab.raw(key)
        return 1 if raw in self.vocab.added else sum([self.word(w)[-1] for w in self.vocab.words(raw)])

    def unit_prefixes(self, key: bytes) -> list[tuple[int, int]]:
        """(bytes, tokens) of each prefix of a unit that ends after a character.

        A prefix splits into words as the unit does, but for two cases: one within the
        leading white space is a single word, and one that cuts a contraction of three
        characters after its first letter has the apostrophe as a word.
        An added token counts as a whole only; its shorter prefixes are ordinary text.
        """
        raw = self.vocab.raw(key)
        if raw in self.vocab.added:
            out = [(size, self.vocab_count(raw[:size])) for size in range(1, len(raw))]
            return [*out, (len(raw), 1)]
        lead = len(_LEAD.match(raw.decode())[0].encode())
        ends = [i for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        space = self.word(raw[:lead])
        out = [(i, space[i]) for i in ends if i <= lead]
        at = before = 0
        for w in self.vocab.words(raw):
            counts = self.word(w)
            cut = len(w) == 3 and _SHORTENED.fullmatch(w.decode("utf-8", "replace"))
            for i in ends:
                if max(at, lead) < i <= at + len(w):
                    out.append((i, before + (2 if cut and i == at + 2 else counts[i - at])))
            at, before = at + len(w), before + counts[-1]
        return out

    def vocab_count(self, text: bytes) -> int:
        """Tokens of a text."""
        return sum(map(self.unit, self.vocab.units(text)))

    def prefixes(self, text: bytes) -> "PrefixTable":
        return PrefixTable(self, text)


class PrefixTable:
    """The exact token count of every prefix of one text (prefixes end after a character)."""

    def __init__(self, counter: PrefixCounter, text: bytes):
        self.counter, self.units = counter, counter.vocab.units(text)
        sizes = [counter.vocab.raw(u) for u in self.units]
        self.starts = [0, *accumulate(map(len, sizes))]
        self.tokens = [0, *accumulate(map(counter.unit, self.units))]

    def count(self, size: int) -> int:
        """Tokens of the first ``size`` bytes."""
        k = bisect_right(self.starts, size) - 1
        if self.starts[k] == size:
            return self.tokens[k]
        return self.tokens[k] + dict(self.counter.unit_prefixes(self.units[k]))[size - self.starts[k]]

    def fits(self, budget: int) -> bool:
        return self.tokens[-1] <= budget

    def cut(self, budget: int) -> int:
        """Bytes of the longest prefix of at most ``budget`` tokens that begins within the last unit that fits."""
        k = bisect_right(self.tokens, budget) - 1
        if k == len(self.units):
            return self.starts[-1]
        return self.starts[k] + max([b for b, n in self.counter.unit_prefixes(self.units[k]) if self.tokens[k] + n <= budget], default=0)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, built once in each worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(vocabulary(path))
    return _COUNTERS[path]


def token_counts(df: DataFrame, vocab_path: str, budget: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: n_bytes, n_tokens, over_limit (more tokens than the budget) and cut_bytes, where to cut it to fit.

    Map only: no shuffle. Memory is bounded by a slice of texts or one text, and the tables kept by a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocab_path)
        vocab, raw = count.vocab, count.vocab.raw
        cache = unit_cache("count", vocab_path, lambda units: list(map(count.unit, units)), 1_200_000)
        for batch in batches:
            for part, texts in slices(batch, 1):
                lists = [vocab.units(t) for t in texts]
                known = cache.get(lists)
                totals, cuts = [], []
                for text, units in zip(texts, lists, strict=True):
                    tokens = list(map(known.__getitem__, units))
                    total = sum(tokens)
                    cut = len(text)
                    if total > budget:
                        upto = list(accumulate(tokens, initial=0))
                        k = bisect_right(upto, budget) - 1
                        cut = sum([len(raw(u)) for u in units[:k]]) + max([b for b, n in count.unit_prefixes(units[k]) if upto[k] + n <= budget], default=0)
                    totals.append(total)
                    cuts.append(cut)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(totals, pa.int64()), pa.array([n > budget for n in totals], pa.bool_()), pa.array(cuts, pa.int64())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit", "cut_bytes"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long")
