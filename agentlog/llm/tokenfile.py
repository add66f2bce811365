"""Token ids in compressed files: a range asymmetric numeral system with static frequencies.

Documents are tokenised once, sorted by id and written as Parquet rows, each with one
block: a run of at most `BLOCK_IDS` ids, coded on its own with the frequencies of the whole
corpus. The ids of a block are dealt to `LANES` interleaved states, so coding is array
arithmetic. A block opens with its checkpoints: every `SECTION_IDS` ids the lanes' states and
the place in the code, with the checksum of the section's ids, so sections of a block can be
decoded alone. A directory in each row holds the documents that start in the block.

The container is Spark's own Parquet writer: task retries and lost executors leave whole
files or none, and any store that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from agentlog.llm.common import store
from agentlog.llm.packing import encoder

BLOCK_IDS = 1 << 18
SECTION_IDS = 1 << 17
LANES = 512
#: Frequencies sum up to 2^PRECISION; states stay in [2^31, 2^63) and shed 32-bit words.
PRECISION = 20
LOWEST = np.uint64(1 << 31)
_WORD = np.uint64(32)
MAGIC = b"RTK1"
#: Magic, lanes, precision, sections, ids, code words, checksum of all that follows.
HEADER = struct.Struct("<4sHHIQQI")
#: First id, words before it and checksum of a section; the lanes' states follow.
SECTION = struct.Struct("<QQII")


# coder

def normalised(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that sum up to 2^precision, at least 1 for every id that occurs: rounded
    down, the rest to the ids with the largest counts."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    if len(used) > 1 << precision:
        raise ValueError("more distinct ids than the precision can tell apart")
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        return freq
    total = int(counts.sum())
    spare = (1 << precision) - len(used)
    freq[used] = 1 + (counts[used].astype(object) * spare // total).astype(np.int64)
    rest = (1 << precision) - int(freq.sum())
    largest = used[np.lexsort((used, -counts[used]))]
    freq[largest[:rest]] += 1  # rest < number of used ids
    return freq


class Coder:
    """Codes ids by a table of frequencies."""

    def __init__(self, freq: np.ndarray, precision: int = PRECISION, lanes: int = LANES) -> None:
        self.precision, self.lanes = precision, lanes
        self.freq = np.asarray(freq, np.uint64)
        self.below = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.shift = np.uint64(precision)
        self.mask = np.uint64((1 << precision) - 1)
        self.limit = (LOWEST >> self.shift) << _WORD  # times the frequency

    def encode(self, ids: np.ndarray, section_ids: int = SECTION_IDS) -> bytes:
        """One block. Id number i belongs to lane i % lanes; rows of lanes are coded from the
        last to the first, so that decoding goes forwards."""
        ids = np.asarray(ids, np.uint32)
        if len(ids) and (int(ids.max()) >= len(self.freq) or not self.freq[ids].all()):
            raise ValueError("an id without frequency")
        lanes, rows_of = self.lanes, max(1, section_ids // self.lanes)
        n_rows = -(-len(ids) // lanes)
        state = np.full(lanes, LOWEST, np.uint64)
        words: list[np.ndarray] = []
        n_words = 0
        marks = []
        freq, below = self.freq[ids], self.below[ids]
        limit, gap = self.limit * freq, (np.uint64(1) << self.shift) - freq
        for row in range(n_rows - 1, -1, -1):
            here = slice(row * lanes, min((row + 1) * lanes, len(ids)))
            x = state[: here.stop - here.start]
            full = np.flatnonzero(x >= limit[here])
            if len(full):
                words.append(x[full][::-1].astype(np.uint32))  # turned round with all words
                n_words += len(full)
                x[full] >>= _WORD
            # x // f * 2^precision + x % f + below
            x += (x // freq[here]) * gap[here] + below[here]
            if row % rows_of == 0:
                own = ids[row * lanes : (row + rows_of) * lanes]
                marks.append((row * lanes, n_words, len(own), zlib.crc32(own.astype("<u4").tobytes()), state.copy()))
        code = np.concatenate(words)[::-1] if words else np.empty(0, np.uint32)
        out = []
        for first, left, n, crc, states in reversed(marks):
            out += [SECTION.pack(first, n_words - left, n, crc), states.astype("<u8").tobytes()]
        body = b"".join([*out, code.astype("<u4").tobytes()])
        return HEADER.pack(MAGIC, lanes, self.precision, len(marks), len(ids), n_words, zlib.crc32(body)) + body

    def decode(self, block: bytes, first: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of the sections that overlap [first, stop), cut to it."""
        magic, lanes, precision, n_sections, n_ids, n_words, crc_of_body = HEADER.unpack_from(block)
        if magic != MAGIC or precision != self.precision:
            raise ValueError("not a block of this format")
        stop = n_ids if stop is None else min(stop, n_ids)
        step = SECTION.size + 8 * lanes
        at = HEADER.size + n_sections * step
        if len(block) != at + 4 * n_words:
            raise ValueError("a block of the wrong length")
        if zlib.crc32(memoryview(block)[HEADER.size :]) != crc_of_body:
            raise ValueError("checksum of the block differs")
        code = np.frombuffer(block, "<u4", offset=at)
        out = []
        for no in range(n_sections):
            place = HEADER.size + no * step
            begin, word, n, crc = SECTION.unpack_from(block, place)
            if begin >= stop or begin + n <= first:
                continue
            states = np.frombuffer(block, "<u8", lanes, place + SECTION.size).astype(np.uint64)
            ids = self._section(code, word, states, n)
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError(f"checksum of section {no} differs")
            out.append(ids[max(0, first - begin) : stop - begin])
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def _section(self, code: np.ndarray, word: int, state: np.ndarray, n: int) -> np.ndarray:
        lanes = len(state)
        ids = np.empty(n, np.uint32)
        for at in range(0, n, lanes):
            width = min(lanes, n - at)
            x = state[:width]
            slot = x & self.mask
            found = self.symbol[slot]
            x = self.freq[found] * (x >> self.shift) + slot - self.below[found]
            short = np.flatnonzero(x < LOWEST)
            if len(short):
                x[short] = (x[short] << _WORD) | code[word : word + len(short)]
                word += len(short)
            state[:width] = x
            ids[at : at + width] = found
        return ids


# checksums of joined parts

def _times(matrix: np.ndarray, vector: int) -> int:
    bits = np.flatnonzero([(vector >> i) & 1 for i in range(32)])
    return int(np.bitwise_xor.reduce(matrix[bits])) if len(bits) else 0


@lru_cache(maxsize=64)
def _zero_bytes(power: int) -> np.ndarray:
    """What 2^power zero bytes do to a CRC-32 register, as a matrix over GF(2) (columns)."""
    if power == 0:
        columns = []
        for bit in range(32):
            x = 1 << bit
            for _ in range(8):
                x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
            columns.append(x)
        return np.array(columns, np.int64)
    half = _zero_bytes(power - 1)
    return np.array([_times(half, int(c)) for c in half], np.int64)


def crc_of_joined(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two texts joined, from theirs and the second's length."""
    power = 0
    while second_bytes:
        if second_bytes & 1:
            first = _times(_zero_bytes(power), first)
        second_bytes >>= 1
        power += 1
    return first ^ second


# writing

BLOCK = T.StructType(
    [
        T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()),
        T.StructField("first_id", T.LongType()),  # ids of the part before the block
        T.StructField("n_ids", T.LongType()), T.StructField("first_doc", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_starts", T.ArrayType(T.LongType())),
        T.StructField("doc_lengths", T.ArrayType(T.LongType())),
        T.StructField("code", T.BinaryType()),
    ]
)
_BLOCK_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
        ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
        ("doc_lengths", pa.list_(pa.int64())), ("code", pa.binary()),
    ]
)


def id_type(n_ids: int) -> str:
    """Little-endian numbers that hold all ids below `n_ids`."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def tokenised(
    docs: DataFrame, vocabulary: str, end_id: int, kind: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, tie, ids): the ids of whole texts and `end_id`, as numbers of type `kind`.
    `tie` orders rows of equal id by their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        tail = np.array(end_id, kind).tobytes()
        for batch in batches:
            ids = [encode(t.as_py() or "").astype(kind).tobytes() + tail for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["doc_id", "tie", "ids"]
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")
    ).mapInArrow(run, "doc_id long, tie long, ids binary")


def id_counts(tokens: DataFrame, n_ids: int, kind: str) -> np.ndarray:
    """How often each id below `n_ids` occurs. Tasks count whole partitions; at most one row
    per id and task is shuffled, one per id reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_ids, np.int64)
        for batch in batches:
            ids = b"".join(x.as_buffer() for x in batch.column(0))
            counts += np.bincount(np.frombuffer(ids, kind), minlength=n_ids)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    found = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(n_ids, np.int64)
    table = found.toArrow()  # n_ids rows at most
    counts[table.column("id").to_numpy()] = table.column("n").to_numpy()
    return counts


def _blocks(freq, kind: str, block_ids: int, section_ids: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value, lanes=lanes)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        row = {"part": part, "block": 0, "first_id": 0, "n_ids": 0, "first_doc": 0, "doc_ids": [], "doc_starts": [], "doc_lengths": []}
        n_docs = total = 0

        def flush(next_doc: int) -> pa.RecordBatch:
            nonlocal row, held
            row["code"] = coder.encode(np.concatenate(held), section_ids)
            done = pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)
            row = {"part": part, "block": row["block"] + 1, "first_id": total, "n_ids": 0, "first_doc": next_doc,
                   "doc_ids": [], "doc_starts": [], "doc_lengths": []}
            held = []
            return done

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), kind)
                if row["n_ids"] == block_ids:
                    yield flush(n_docs)
                row["doc_ids"].append(doc_id)
                row["doc_starts"].append(total)
                row["doc_lengths"].append(len(ids))
                at = 0
                while at < len(ids):
                    if row["n_ids"] == block_ids:
                        yield flush(n_docs)  # the document goes on in the next block
                    take = ids[at : at + block_ids - row["n_ids"]]
                    held.append(take)
                    row["n_ids"] += len(take)
                    total += len(take)
                    at += len(take)
                n_docs += 1
        if held:
            yield flush(n_docs)

    return run


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    block_ids: int = BLOCK_IDS, section_ids: int = SECTION_IDS, lanes: int = LANES,
) -> None:
    """Write the ids of all documents to `path`/blocks, in ascending order of their id, and
    the frequencies to `path`/frequencies.

    A null id comes first; rows of equal id are ordered by their text, repeated rows are all
    written. A null text is empty and gives `end_id` alone. Texts are whole, and a document
    of any length spans as many blocks as it needs. Other columns are ignored. An empty table
    writes no block. `vocabulary` must be readable on every executor.
    """
    n_ids = max(len(encoder(vocabulary).tokenizer.get_vocab(with_added_tokens=True)), end_id + 1)
    kind = id_type(n_ids)
    tokens = store(tokenised(docs, vocabulary, end_id, kind, id_col, text_col), "tokens")
    freq = normalised(id_counts(tokens, n_ids, kind))
    spark = docs.sparkSession
    used = np.flatnonzero(freq)
    spark.createDataFrame(
        pa.table({"id": pa.array(used, pa.int64()), "frequency": pa.array(freq[used], pa.int64())})
    ).coalesce(1).write.parquet(f"{path}/frequencies")
    (
        tokens.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
        .mapInArrow(_blocks(spark.sparkContext.broadcast(freq), kind, block_ids, section_ids, lanes), BLOCK)
        .write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    )


# reading

def frequencies(spark: SparkSession, path: str) -> np.ndarray:
    """The shared table, at most 2^PRECISION rows."""
    table = spark.read.parquet(f"{path}/frequencies").toArrow()
    ids = table.column("id").to_numpy()
    freq = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    freq[ids] = table.column("frequency").to_numpy()
    return freq


_PIECE = pa.schema(
    [
        ("part", pa.int32()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
        ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()),
    ]
)


def _pieces(freq, keep_ids: bool):
    """Decoded parts of documents: which document of its part, its first id's place, crc and,
    on demand, ids. start and length are null in all but a document's first piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value)
        for batch in batches:
            for no in range(batch.num_rows):
                row = {c: batch.column(c)[no].as_py() for c in batch.schema.names if c != "code"}
                ids = coder.decode(batch.column("code")[no].as_buffer().to_pybytes())
                if len(ids) != row["n_ids"]:
                    raise ValueError("a block with another number of ids than its row says")
                first, stop = row["first_id"], row["first_id"] + row["n_ids"]
                starts = row["doc_starts"]
                cuts = sorted({first, *[s for s in starts if s < stop], stop})
                opened = len(starts) and starts[0] == first
                out = []
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[a - first : b - first].astype("<u4").tobytes()
                    begins = k if opened else k - 1
                    known = begins >= 0
                    out.append(
                        {
                            "part": row["part"], "doc": row["first_doc"] + k,
                            "doc_id": row["doc_ids"][begins] if known else None,
                            "start": starts[begins] if known else None,
                            "length": row["doc_lengths"][begins] if known else None,
                            "at": a, "n": b - a, "crc": zlib.crc32(own), "ids": own if keep_ids else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=_PIECE)

    return run


def _joined_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for pieces in batch.column("pieces").to_pylist():
            whole = 0
            for p in pieces:
                whole = crc_of_joined(whole, p["crc"], 4 * p["n"])
            crcs.append(whole)
        names = [n for n in batch.schema.names if n != "pieces"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(crcs, pa.int64())], names=[*names, "ids_crc32"]
        )


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, on demand, ids (little-endian bytes) of all
    documents of `path`, decoded block by block in parallel.

    A document inside one block is finished by the task that decodes it; only the pieces of
    documents that cross blocks are grouped, their checksums joined by length. With
    `keep_ids` a document's bytes are joined, so each must fit a row.
    """
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    freq = spark.sparkContext.broadcast(frequencies(spark, path))
    schema = "part int, doc long, doc_id long, start long, length long, at long, n long, crc long, ids binary"
    pieces = blocks.mapInArrow(_pieces(freq, keep_ids), schema)
    pieces = store(pieces, "pieces")
    whole = F.col("length").eqNullSafe(F.col("n"))
    one = pieces.filter(whole).select("part", "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "ids")
    crossing = (
        pieces.filter(~whole).groupBy("part", "doc").agg(
            F.max("doc_id").alias("doc_id"), F.max("start").alias("start"), F.max("length").alias("length"),
            F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"),
            F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"),
        )
        .select(
            "part", "doc_id", "start", "length", "pieces",
            F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"),
        )
        .mapInArrow(_joined_crcs, "part int, doc_id long, start long, length long, ids binary, ids_crc32 long")
        .select("part", "doc_id", "start", "length", "ids_crc32", "ids")
    )
    # one row per part: the ids of all parts before
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("before"))
    docs = one.union(crossing).join(offsets, "part").select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("length").alias("n_tokens"), "ids_crc32",
        *(["ids"] if keep_ids else []),
    )
    return docs


def read_range(spark: SparkSession, path: str, first: int, stop: int) -> DataFrame:
    """(at, ids) of the corpus's ids number `first` to `stop`, per block: only the blocks and
    sections that overlap the range are decoded. `at` is the number of the first id."""
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    freq = spark.sparkContext.broadcast(frequencies(spark, path))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_part")).select(
        "part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("before")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value)
        for batch in batches:
            begins = batch.column("begin").to_pylist()
            out = []
            for at, code in zip(begins, batch.column("code")):
                ids = coder.decode(code.as_buffer().to_pybytes(), max(0, first - at), stop - at)
                out.append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([max(first, at) for at in begins], pa.int64()), pa.array(out, pa.binary())], names=["at", "ids"]
            )

    begin = F.col("before") + F.col("first_id")
    return (
        blocks.join(offsets, "part").withColumn("begin", begin)
        .filter((F.col("begin") < stop) & (F.col("begin") + F.col("n_ids") > first))
        .select("begin", "code").mapInArrow(run, "at long, ids binary")
    )
