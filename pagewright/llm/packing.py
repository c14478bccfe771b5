"""Harmonic packing of token sequences (operator 10).

Method: piece lengths fall into reciprocal-capacity classes. Class k holds pieces of
at most capacity // k tokens, and a bin of class k takes exactly k of them. A
document is cut into full bins and a rest; the rest stays whole if it nearly fills
its class, else the largest class capacity within it is cut off and what is left is
treated likewise, so that every piece nearly fills its share. Each worker fills its
classes' bins by itself; the few pieces that are in open bins when its rows end are
laid end to end into bins of their own, cut where a bin is full, and the last of
these bins is cut at powers of two, which need no padding.

Defined results for odd input: null or empty text has the end id alone; documents
longer than a bin are cut; an empty table gives an empty result; repeated rows are
packed each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._scratch import slices
from pagewright.llm.bytepair import Vocabulary, unit_cache, vocabulary

#: Share of its class's capacity that a piece has at least, unless it is cut.
FILL = 0.985


class HarmonicPacker:
    """Bins of one worker. Pieces are (document, start, length); bins come out as lists of them."""

    def __init__(self, capacity: int, fill: float = FILL):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}
        #: per length of a rest: the lengths of its pieces, each with its class
        self.plan: list[list[tuple[int, int]]] = [[]]
        for r in range(1, capacity):
            k = capacity // r  # the class: k pieces of this length fit
            if r >= fill * (capacity // k):
                self.plan.append([(r, k)])
            else:
                cut = capacity // (k + 1)
                self.plan.append([(cut, k + 1), *self.plan[r - cut]])

    def add(self, doc, length: int, start: int = 0) -> Iterator[list[tuple]]:
        """Cut a document (from start on), and give the bins that are full now."""
        rest = length
        while rest >= self.capacity:
            yield [(doc, start, self.capacity)]
            start, rest = start + self.capacity, rest - self.capacity
        for size, k in self.plan[rest]:
            held = self.open.setdefault(k, [])
            held.append((doc, start, size))
            start += size
            if len(held) == k:
                del self.open[k]
                yield held

    def close(self) -> Iterator[list[tuple]]:
        """The bins of what is still open."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(n for _, _, n in rest)
        room = 0
        held: list[tuple] = []
        for doc, start, n in rest:
            while n:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                take = min(n, room)
                held.append((doc, start, take))
                start, n, room, left = start + take, n - take, room - take, left - take
                if not room:
                    yield held
                    held = []


def _bytes_learner(vocab: Vocabulary):
    def learn(units: list[bytes]) -> Iterator[bytes]:
        ids, ends = vocab.encode_units(units)
        raw, ends = ids.astype("<u4").tobytes(), (ends * 4).tolist()
        return (raw[s:e] for s, e in zip(ends, ends[1:], strict=False))

    return learn


def pack(df: DataFrame, vocab_path: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", fill: float = FILL) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    sequence_tokens is the sequence's length without padding. Map only: each partition
    packs its own rows, and sequence ids carry the partition's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        cache = unit_cache("bytes", vocab_path, _bytes_learner(vocab))
        packer = HarmonicPacker(capacity, fill)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        kind = None

        def rows(bins: Iterator[list[tuple]]) -> Iterator[tuple]:
            nonlocal sequence
            for held in bins:
                offset, total = 0, sum(n for _, _, n in held)
                for (id_, tokens, base, raw), start, n in held:  # raw: the ids' bytes from base on
                    at = (start - base) * 4
                    yield id_, start, n, zlib.crc32(raw[at : at + 4 * n]), tokens, sequence, offset, total
                    offset += n
                sequence += 1

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[id_col, *_NAMES])

        for batch in batches:
            kind = batch.schema.field(0).type
            for part, texts in slices(batch, 1):
                lists = [vocab.units(t) for t in texts]
                known = cache.get(lists)
                out: list[tuple] = []
                for id_, units in zip(part.column(0).to_pylist(), lists, strict=True):
                    raw = b"".join([*map(known.__getitem__, units), end])
                    tokens = len(raw) // 4
                    kept = tokens // capacity * capacity
                    # open pieces lie in the rest, so no whole text stays in memory
                    out += rows(packer.add((id_, tokens, 0, raw), kept)) if kept else ()
                    out += rows(packer.add((id_, tokens, kept, raw[4 * kept :]), tokens - kept, kept))
                if out:
                    yield batch_of(out)
        if out := list(rows(packer.close())):
            yield batch_of(out)

    kind_ = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind_}, " + ", ".join(f"{n} long" for n in _NAMES))


_NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]

