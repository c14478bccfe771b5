"""Language identification by words first, then shorter and shorter n-grams (operator 5).

Method: a known word is scored by its log frequency in each language. An unseen word
falls back to its character n-grams of the greatest length of which any is known, and
so on down to single characters; a word of which nothing is known counts for nothing.
Each word's scores are put on one scale (log shares that sum to one), and a document's
score is their sum over all its words.

Training counts all words and n-grams of a sample of the labelled rows. The sample is the
one bound: about ``rows_per_language`` distinct rows of each language and ``sample_rows``
of all, chosen by a hash of id and text; every label and n-gram in it is kept, and every
word that occurs ``least_count`` times (a rarer one tells less than its n-grams). The
model holds the counts that occur, so it grows with the sample and not with words times
languages; a worker unfolds words to all languages within ``CACHE_BYTES``.

Defined results for odd input: null text, or text without a letter, is ``und`` with
score 0; so is every text if there is nothing to learn from; a null id is never held
out, and its rows are trained on like others; a repeated row is learned from once;
repeated rows get equal results; an empty table gives an empty result; other columns are
ignored, and kept ones may not have the names of results (``prefix`` renames those);
whole texts are scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm._scratch import dropped, kept, slices, written

UNDETERMINED = "und"
#: Bounds of the training sample: distinct rows of a language, and of all. Longest n-grams.
ROWS_PER_LANGUAGE, SAMPLE_ROWS, LONGEST = 2000, 40_000, 4
#: Times that a word occurs in the sample if it counts as known.
LEAST_COUNT = 3
#: Words and bytes of their scores that a worker keeps.
CACHE_WORDS, CACHE_BYTES = 300_000, 96 << 20
#: Numbers of a level up to which a worker unfolds it whole.
UNFOLDED = 1 << 21
_LETTERS = regex.compile(r"\p{L}+")
#: Words of whose evidence a certain document needs at least so many.
EVIDENCE = 10
#: Log frequency of a trigram never seen, against the typical one, however much was learned from.
UNSEEN = -10.0


@dataclass
class Level:
    """Log frequencies of words, or of n-grams of one length: those that occur, and for each language that of any other."""

    rows: dict[str, int]
    starts: np.ndarray
    langs: np.ndarray
    logs: np.ndarray
    rest: np.ndarray
    whole: np.ndarray | None = None

    @classmethod
    def of(cls, counts: pd.DataFrame, n: int) -> "Level":
        """From columns key, lang (a number under n) and n; each pair once."""
        counts = counts.sort_values(["key", "lang"])
        codes, keys = pd.factorize(counts["key"])
        langs, times = counts["lang"].to_numpy(np.intp), counts["n"].to_numpy(float)
        all_ = np.log(np.bincount(langs, times, n) + 0.5 * max(1, len(keys)))
        return cls({k: i for i, k in enumerate(keys)}, np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(keys))))), langs, np.log(times + 0.5) - all_[langs], np.log(0.5) - all_)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """The log frequencies of some rows in all languages."""
        if self.whole is None and len(self.rows) * len(self.rest) <= UNFOLDED:
            self.whole = self._unfolded(np.arange(len(self.rows)))
        return self._unfolded(rows) if self.whole is None else self.whole[rows]

    def _unfolded(self, rows: np.ndarray) -> np.ndarray:
        out = np.tile(self.rest, (len(rows), 1))
        sizes = self.starts[rows + 1] - self.starts[rows]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes)
        out[np.repeat(np.arange(len(rows)), sizes), self.langs[at]] = self.logs[at]
        return out

    def typical(self) -> np.ndarray:
        """For each language the mean log frequency, every entry weighted by its frequency."""
        n = len(self.rest)
        others = len(self.rows) - np.bincount(self.langs, minlength=n)
        p, rest = np.exp(self.logs), np.exp(self.rest)
        total = np.bincount(self.langs, p, n) + others * rest
        return np.divide(np.bincount(self.langs, p * self.logs, n) + others * rest * self.rest, total, out=np.zeros(n), where=total > 0)


@dataclass
class Model:
    """Known words, and n-grams (between word borders) by length from 1."""

    languages: list[str]
    words: Level | None = None
    grams: list[Level] = field(default_factory=list)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def shares(self, words: list[str]) -> np.ndarray:
        """Log shares over the languages of each word; zero if nothing is known of it."""
        out, unseen = np.zeros((len(words), len(self.languages))), []
        known = self.words.rows.get
        rows = [known(w, -1) for w in words]
        at = np.flatnonzero(np.array(rows, np.intp) >= 0)
        if len(at):
            out[at] = _shares(self.words.dense(np.array(rows, np.intp)[at]))
        unseen = [(i, f"^{w}$") for i, (w, r) in enumerate(zip(words, rows, strict=True)) if r < 0]
        for level, n in zip(reversed(self.grams), range(len(self.grams), 0, -1), strict=True):
            get, found, left = level.rows.get, [], []
            for i, framed in unseen:
                own = [r for r in (get(framed[j : j + n]) for j in range(len(framed) - n + 1)) if r is not None]
                found.append((i, own)) if own else left.append((i, framed))
            unseen = left
            for part in range(0, len(found), 4096):
                some = found[part : part + 4096]
                sizes = np.fromiter((len(own) for _, own in some), np.intp, len(some))
                sums = np.add.reduceat(level.dense(np.fromiter(chain.from_iterable(own for _, own in some), np.intp, sizes.sum())), np.cumsum(sizes) - sizes)
                out[[i for i, _ in some]] = _shares(sums / sizes[:, None])
        return out


def _shares(scores: np.ndarray) -> np.ndarray:
    """Log shares that sum to one over the last axis."""
    top = scores.max(-1, keepdims=True)
    return scores - top - np.log(np.exp(scores - top).sum(-1, keepdims=True))


def held_out(id_: Column) -> Column:
    """Documents that are kept for testing."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS, least_count: int = LEAST_COUNT) -> Model:
    """Learn from the rows with a text and a language. The driver gets the counts of a bounded sample, and one row a label."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([])
    languages = sorted(sizes)
    aim = min(rows_per_language, max(1, sample_rows // len(languages)))
    part = [F.lit(x) for lang, n in sizes.items() if n > aim for x in (lang, aim / n)]
    share = F.coalesce(F.try_element_at(F.create_map(*part), F.col("lang")), F.lit(1.0)) if part else F.lit(1.0)
    key = F.xxhash64(F.lit("sample"), "id", "text")
    chosen = rows.withColumn("key", key).filter(F.pmod("key", F.lit(1_000_000)) / 1e6 < share)
    sample = chosen.groupBy("lang", "key").agg(F.first("text").alias("text"))
    words = written(sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("key")).groupBy("key", "lang").agg(F.count("*").alias("n")), "words")
    framed = F.concat(F.lit("^"), "key", F.lit("$"))
    cuts = lambda size: F.transform(F.sequence(F.lit(1), F.length(framed) - size + 1), lambda i: F.struct(F.lit(size).alias("size"), F.substring(framed, i, F.lit(size)).alias("key")))
    every = F.concat(*[F.when(F.length(framed) >= size, cuts(size)).otherwise(F.array().cast("array<struct<size:int,key:string>>")) for size in range(1, LONGEST + 1)])
    grams = words.select("lang", "n", F.explode(every).alias("g")).groupBy("g.size", "g.key", "lang").agg(F.sum("n").alias("n"))
    number = {x: i for i, x in enumerate(languages)}
    known, parts = words.toArrow().to_pandas(), grams.toArrow().to_pandas()
    dropped(words)
    for counts in (known, parts):
        counts["lang"] = counts["lang"].map(number).astype(np.int64)
    n = len(languages)
    known = known[known.groupby("key")["n"].transform("sum") >= least_count]
    return Model(languages, Level.of(known, n), [Level.of(parts[parts["size"] == size], n) for size in range(1, LONGEST + 1)])


class Sums:
    """Sums of the vectors of words, with the vectors met so far kept within a bound."""

    def __init__(self, width: int, make: Callable[[list[str]], np.ndarray], limit: int):
        self.width, self.make, self.limit = width, make, max(1, limit)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, self.width))

    def learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if len(self.rows) + len(new) > self.limit:
            self.forget()
            new = list(dict.fromkeys(words))
        if not new:
            return
        used, need = len(self.rows), len(self.rows) + len(new)
        if need > len(self.table):
            self.table = np.concatenate((self.table[:used], np.zeros((min(self.limit, max(need, 2 * used)) - used, self.width))))
        self.table[used:need] = self.make(new)
        self.rows.update(zip(new, range(used, need), strict=True))

    def totals(self, lists: list[list[str]]) -> np.ndarray:
        """The sum of each list, in parts of as many words as may be kept."""
        out, group, size = np.zeros((len(lists), self.width)), [], 0

        def flush() -> None:
            self.learn([w for _, part in group for w in part])
            row = self.rows.__getitem__
            for at, part in group:
                out[at] += self.table[list(map(row, part))].sum(0)
            group.clear()

        for at, words in enumerate(lists):
            for s in range(0, len(words), self.limit):
                part = words[s : s + self.limit]
                if size + len(part) > self.limit:
                    flush()
                    size = 0
                group.append((at, part))
                size += len(part)
        flush()
        return out


class Scorer:
    """A model in a worker."""

    def __init__(self, model: Model, limit: int = CACHE_WORDS):
        self.model, n = model, len(model.languages)
        limit = min(limit, CACHE_BYTES // (8 * (n + 1)))
        self.words, self.trigrams, self.typical = Sums(n, model.shares, limit), Sums(n + 1, self._trigrams, limit), None

    def _trigrams(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its trigrams' log frequencies in each language, and their number."""
        level, unseen = self.model.grams[2], self.typical + UNSEEN
        out, get = np.zeros((len(words), len(unseen) + 1)), level.rows.get
        for at in range(0, len(words), 8192):
            framed = [f"^{w}$" for w in words[at : at + 8192]]
            sizes = np.fromiter((len(w) - 2 for w in framed), np.intp, len(framed))  # one at least
            rows = np.fromiter((get(w[i : i + 3], -1) for w in framed for i in range(len(w) - 2)), np.intp, sizes.sum())
            logs = np.broadcast_to(unseen, (len(rows), len(unseen))).copy()
            seen = rows >= 0
            logs[seen] = np.maximum(level.dense(rows[seen]), unseen)
            out[at : at + len(framed), :-1] = np.add.reduceat(logs, np.cumsum(sizes) - sizes)
            out[at : at + len(framed), -1] = sizes
        return out

    def fluencies(self, lists: list[list[str]], langs: list[str]) -> list[float | None]:
        """Mean log frequency of a text's trigrams in its language, less the mean of labelled rows; none if undetermined.

        Unlike the score it does not depend on which other languages there are.
        """
        if not self.model.languages:
            return [None] * len(lists)
        if self.typical is None:
            self.typical = self.model.grams[2].typical()
        number = {x: i for i, x in enumerate(self.model.languages)}
        sums = self.trigrams.totals([[] if x == UNDETERMINED else words for words, x in zip(lists, langs, strict=True)])
        return [float(s[number[x]] / s[-1] - self.typical[number[x]]) if s[-1] else None for s, x in zip(sums, langs, strict=True)]

    def classify(self, lists: list[list[str]]) -> tuple[list[str], list[float]]:
        """Language and score of each text, given as its words."""
        languages = self.model.languages
        if not languages:
            return [UNDETERMINED] * len(lists), [0.0] * len(lists)
        sizes = np.array([len(x) for x in lists])
        posterior = np.exp(_shares(self.words.totals(lists) * np.minimum(1.0, EVIDENCE / np.maximum(1, sizes))[:, None]))
        best = posterior.argmax(1)  # of equal ones the first by name
        langs = [languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]
        return langs, np.where(sizes > 0, posterior.max(1), 0.0).tolist()


def words_of(text: bytes) -> list[str]:
    return _LETTERS.findall(text.decode().lower())


def scorer(model: Model) -> Scorer:
    """The worker's scorer of a model."""
    return kept(("language", model.name), lambda: Scorer(model))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), fluency: bool = False, prefix: str = "") -> DataFrame:
    """The id, the columns named in keep, lang_pred and score (on demand also the fluency) of every whole text. Map only."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)  # the counts of a bounded sample
    names = [id_col, text_col, *[c for c in keep if c not in (id_col, text_col)]]
    shown = [c for c in names if c in keep or c == id_col]
    made = [f"{prefix}lang_pred", f"{prefix}score", *([f"{prefix}fluency"] if fluency else [])]
    if clash := {c.lower() for c in shown} & {c.lower() for c in made}:
        raise ValueError(f"columns {sorted(clash)} are kept and made: give a prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(sent.value)
        for batch in batches:
            for part, texts in slices(batch, 1, 4 << 20):
                lists = [words_of(t) for t in texts]
                langs, scores = own.classify(lists)
                columns = [part.column(names.index(c)) for c in shown]
                more = [pa.array(own.fluencies(lists, langs), pa.float64())] if fluency else []
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *more], names=[*shown, *made])

    fields = df.select(*[F.col(c) for c in names]).schema
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in shown), *(f"`{c}` {kind}" for c, kind in zip(made, ("string", "double", "double"), strict=False))])
    return df.select(*[F.col(c) for c in names]).mapInArrow(run, schema)
