"""Pack tokenised documents into sequences of fixed capacity.

Pieces are dealt at random into groups that fit one task. A group is packed best fit first
and then improved by local search: documents move, swap one for one or two for one between
underfull bins, each step raising the sum of squared fills, until bins run empty.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from agentlog.llm.common import fresh, store

#: Pieces per group: one partly filled bin is left over in each.
GROUP_ROWS = 16_384
#: Words whose ids a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 1_000_000


# tokens

def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: visible Latin-1 letters stand for themselves, the other bytes for
    the code points from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds(dict):
    """Token ids of a lower-case word without white space, as the whole tokenizer gives them:
    little-endian 32-bit numbers, ready to be joined."""

    #: The vocabulary's own split pattern, for ordinary texts (see `DocumentEncoder.ODD`).
    PARTS = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\w\s²³¹¼-¾]|_)+"
    )
    LETTERS = _byte_letters()

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.model = tokenizer.model

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(".,")
        if stem.isalpha():  # a plain word, perhaps with its full stop or comma
            found = self._part(word) if stem == word else self[stem] + self[word[len(stem) :]]
        else:
            found = b"".join(map(self._part, self.PARTS.findall(word)))
        self[word] = found
        return found

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.LETTERS)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()


class DocumentEncoder:
    """Ids of whole texts. Ordinary texts are split into words, whose ids are remembered;
    texts with rare letters, control characters or special tokens take the tokenizer itself."""

    ODD = re.compile("[^\t-\r -~\x80-\u024f\u2010-\u2027]|<\\||[\u0085\u00a0]")

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.words = WordIds(self.tokenizer)

    def encode(self, text: str) -> np.ndarray:
        if self.ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.lower().split())), "<u4")


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> DocumentEncoder:
    return DocumentEncoder(vocabulary)


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """The pieces of every document: id, piece, start, length, ids_crc32 and, on demand, ids.

    A document is the ids of its whole text and then `end_id`; null is an empty text, so
    every row has at least one token. Only documents above `capacity` are cut, into pieces
    of that length and a shorter last one. Repeated rows give repeated pieces; an empty
    table gives no pieces. `vocabulary` must be readable on every executor.
    """
    id_field = docs.schema[id_col]
    fields = [
        T.StructField(id_col, id_field.dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(texts):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                for no, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append(row)
                    piece.append(no)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype("int32"))
            columns = [
                keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(cut, T.StructType(fields))


# bins

class Bins:
    """Bins of one group under local search."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bin_of = np.zeros(len(sizes), dtype=np.int64)
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self._best_fit()
        self.least = math.ceil(int(sizes.sum()) / capacity)

    def _best_fit(self) -> None:
        """Largest first, each into the fullest bin with room."""
        room: list[int] = []  # sorted distinct rooms
        bins_with: dict[int, list[int]] = {}
        for item in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[item])
            at = bisect.bisect_left(room, size)
            if at == len(room):
                target, left = len(self.items), self.capacity
                self.items.append([])
                self.fill.append(0)
            else:
                left = room[at]
                target = bins_with[left].pop()
                if not bins_with[left]:
                    del bins_with[left]
                    room.pop(at)
            self.items[target].append(item)
            self.fill[target] += size
            self.bin_of[item] = target
            left -= size
            if left:
                if left not in bins_with:
                    bisect.insort(room, left)
                    bins_with[left] = []
                bins_with[left].append(target)

    def _relocate(self, item: int, target: int) -> None:
        source, size = int(self.bin_of[item]), int(self.sizes[item])
        self.items[source].remove(item)
        self.items[target].append(item)
        self.fill[source] -= size
        self.fill[target] += size
        self.bin_of[item] = target

    def search(self, patience: int) -> None:
        """Raise the sum of squared fills until the least number of bins is reached, no step
        helps, or `patience` passes emptied no bin. A step takes from an emptier bin to a
        fuller one, so the emptiest bins drain. Sources of a pass are the emptiest bins, some
        times as many as are above the least number."""
        self.fill = np.asarray(self.fill, dtype=np.int64)
        idle = 0
        while idle < patience:
            used = np.flatnonzero(self.fill)
            surplus = len(used) - self.least
            if surplus <= 0:
                return
            order = used[np.argsort(self.fill[used], kind="stable")][: 4 * surplus + 64]
            moved, emptied = False, 0
            for source in order.tolist():
                while self.fill[source] and self._step(source):
                    moved = True
                emptied += not self.fill[source]
                if emptied >= surplus:
                    return
            if not moved:
                return
            idle = 0 if emptied else idle + 1

    def _step(self, source: int) -> bool:
        """One improving step out of `source`: a move, else a swap, else two for one."""
        have = self.fill[source]
        if have == self.capacity:
            return False
        room = np.where((self.fill > 0), self.capacity - self.fill, 0)
        room[source] = 0
        alike: dict[int, list[int]] = {}  # items of equal size allow the same steps
        for item in sorted(self.items[source], key=lambda i: (-self.sizes[i], i)):
            alike.setdefault(int(self.sizes[item]), []).append(item)
        mine = [same[0] for same in alike.values()]
        for item in mine:
            size = self.sizes[item]
            fits = np.flatnonzero((room >= size) & (self.fill + size > have))
            if len(fits):
                self._relocate(item, int(fits[np.argmin(room[fits])]))
                return True
        their_room = room[self.bin_of]
        others = np.flatnonzero(their_room)
        theirs, their_room = self.sizes[others], their_room[others]
        their_fill = self.fill[self.bin_of[others]]
        pairs = [(a,) for a in mine]
        for i, same in enumerate(alike.values()):
            pairs += [(same[0], b) for b in same[1:2] + mine[i + 1 :]]
        for given in pairs:
            gain = int(self.sizes[list(given)].sum()) - theirs
            good = np.flatnonzero((gain > 0) & (gain <= their_room) & (their_fill + gain > have))
            if len(good):
                best = int(others[good[np.argmin(their_room[good] - gain[good])]])
                target = int(self.bin_of[best])
                self._relocate(best, source)
                for item in given:
                    self._relocate(item, target)
                return True
        return False


def pack_group(
    sizes: np.ndarray, capacity: int, patience: int = 2
) -> tuple[np.ndarray, np.ndarray]:
    """Bin (numbered without gaps) and offset of every item. `patience` bounds the search,
    not the items: every item is packed."""
    bins = Bins(np.asarray(sizes, dtype=np.int64), capacity)
    bins.search(patience)
    _, number = np.unique(bins.bin_of, return_inverse=True)
    order = np.argsort(number, kind="stable")
    ends = np.cumsum(bins.sizes[order])
    starts = ends - bins.sizes[order]
    first = np.r_[True, number[order][1:] != number[order][:-1]] if len(order) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, starts, 0))
    offset = np.empty(len(order), dtype=np.int64)
    offset[order] = starts - base
    return number, offset


def pack(
    pieces: DataFrame, capacity: int = 2048, length_col: str = "length",
    group_rows: int = GROUP_ROWS, seed: int = 0,
) -> DataFrame:
    """All of `pieces` with sequence_id and offset, no sequence above `capacity`.

    Lengths must lie between 1 and `capacity`. Pieces that fill a sequence are placed
    without Python; the rest is dealt by a hash of the row's place into groups of about
    `group_rows`, so repeated rows and hot keys spread like all others. Sequence numbers are
    unique, not gapless; offsets in a sequence are gapless from 0. An empty table gives an
    empty result; columns named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    row, group = fresh(pieces, "__row"), fresh(pieces, "__group")
    stored = store(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    full = stored.filter(F.col(length_col) >= capacity).select(
        *pieces.columns, (F.col(row) * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = stored.filter(F.col(length_col) < capacity)
    n_groups = max(1, math.ceil(rest.count() / group_rows))
    dealt = rest.withColumn(group, F.pmod(F.xxhash64(F.lit(seed), row), F.lit(n_groups)))

    names = full.columns

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(row, kind="stable", ignore_index=True)
        number, offset = pack_group(frame[length_col].to_numpy(), capacity)
        base = int(frame[group].iloc[0]) << 31
        frame["sequence_id"], frame["offset"] = (base + number) * 2, offset
        return frame[names]

    packed = dealt.groupBy(group).applyInPandas(place, full.schema)
    return full.unionByName(packed)
