"""Prefix trie of conversations: double-array tries per shard, upper nodes merged globally.

Every conversation is a path of turn keys. Paths are range sorted, so a shard (a bounded run
of sorted paths) holds whole subtrees but for the nodes on its first and its last path, its
spine. A task numbers the turns of a shard densely, packs the trie into BASE and CHECK
arrays, walks all paths through them at once and sums up subtrees. Nodes off the spine are
finished there; spine nodes leave as partial sums and are merged over all shards, so neither
a hot first turn nor thousands of equal conversations gather in one task.

Long conversations are cut into layers of bounded depth: the end of a full path is the root
of the next layer, and layers are summed up from the deepest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from agentlog.llm.common import running_totals, store

#: Turns of a path within one layer.
LAYER_TURNS = 512
#: Turns of a shard; one path at least.
SHARD_TURNS = 200_000
#: Members' ids in one row of a spine node's list.
LIST_IDS = 4_096
#: Bytes of a turn's key, the head of a SHA-256.
KEY = 16
#: Free places that a node with several children tries before it goes to the end.
TRIES = 64


# packing

class DoubleArray:
    """A static trie over dense codes: the child of node s by code c is t = base[s] + c if
    check[t] == s. Node 0 is the root."""

    def __init__(self, capacity: int) -> None:
        self.base = np.zeros(capacity, np.int64)
        self.check = np.full(capacity, -1, np.int64)
        self.check[0] = 0
        self.free = 1  # no place below is free
        self.end = 1  # all places from here on are free

    def _reserve(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def add(self, node: int, codes: np.ndarray) -> None:
        """Place all children of `node`; `codes` ascend and are not empty."""
        while self.free < self.end and self.check[self.free] >= 0:
            self.free += 1
        width = int(codes[-1] - codes[0])
        self._reserve(max(self.end, self.free + 1) + width + TRIES + 1)
        steps = codes - codes[0]
        open_places = np.flatnonzero(self.check[self.free : self.free + TRIES] < 0) + self.free
        for place in open_places:
            if (self.check[place + steps] < 0).all():
                break
        else:
            place = max(self.end, self.free)
        self.base[node] = place - codes[0]
        self.check[place + steps] = node
        self.end = max(self.end, int(place) + width + 1)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of many nodes at once."""
        found = self.base[nodes] + codes
        if (self.check[found] != nodes).any():
            raise KeyError("a path is not in the trie")
        return found


def dense_codes(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Numbers 0.. of the distinct keys in the order of their first level and place, so that
    children of one node mostly get neighbouring numbers."""
    _, first, code = np.unique(keys, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((first, level[first]))] = np.arange(len(first))
    return rank[code.reshape(-1)]


def build(
    codes: np.ndarray, start: np.ndarray, length: np.ndarray
) -> tuple[DoubleArray, list[np.ndarray], list[np.ndarray]]:
    """Pack paths (slices of `codes`, in sorted order) and walk them: the trie, and per level
    the rows that reach it and their nodes."""
    trie = DoubleArray(len(codes) + 2)
    rows = np.arange(len(start))
    at = np.zeros(len(start), np.int64)
    reached, places = [], []
    for level in range(int(length.max(initial=0))):
        keep = length[rows] > level
        rows, at = rows[keep], at[keep]
        code = codes[start[rows] + level]
        # paths are sorted, so the children of a node are runs of its rows
        new = np.ones(len(rows), bool)
        new[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1])
        parents, children = at[new], code[new]
        cuts = np.flatnonzero(np.diff(parents)) + 1
        for node, group in zip(parents[np.r_[0, cuts]], np.split(children, cuts)):
            trie.add(int(node), np.sort(group))
        at = trie.step(at, code)
        reached.append(rows)
        places.append(at)
    return trie, reached, places


# one shard

_FIELDS = [
    ("kind", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("parent_conv_id", pa.int64()),
    ("layer_key", pa.binary()), ("level", pa.int32()), ("shard", pa.int64()), ("side", pa.int32()),
    ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved", pa.int64()), ("n_bytes", pa.int64()), ("x_children", pa.int64()), ("x_leaves", pa.int64()),
    ("x_saved", pa.int64()), ("part", pa.int64()), ("ends", pa.string()),
]
_ARROW = pa.schema(_FIELDS)
_SPARK = T.StructType(
    [
        T.StructField(name, {"string": T.StringType(), "binary": T.BinaryType(), "int64": T.LongType(), "int32": T.IntegerType()}[str(kind)])
        for name, kind in _FIELDS
    ]
)


def _digest(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:KEY]


def _ids(conv_ids: np.ndarray) -> str:
    return ",".join(map(str, conv_ids.tolist()))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shard_rows(
    paths: list[bytes], sizes: list[np.ndarray], conv_ids: np.ndarray, root_ids: np.ndarray,
    ends: np.ndarray, extras: np.ndarray, shard: int,
) -> Iterator[dict]:
    """Rows of one shard: finished nodes, partial spine nodes, and lists of the members that
    end in spine nodes.

    `paths` are sorted, equal ones by conv_id. A path is the key of its layer and the keys of
    its turns, `sizes` their bytes; `root_ids` holds the smallest member of the layer's root,
    `ends` says that the conversation ends here, `extras` are the children, leaves and savings
    below the end of a path that goes on.
    """
    length = np.array([len(p) // KEY for p in paths], np.int64)
    start = np.cumsum(length) - length
    keys = np.frombuffer(b"".join(paths), dtype=f"V{KEY}")
    level_of = np.arange(len(keys)) - np.repeat(start, length)
    trie, reached, places = build(dense_codes(keys, level_of), start, length)
    turn_bytes = np.concatenate([np.r_[0, s] for s in sizes]).astype(np.int64)

    n = trie.end
    members = np.zeros(n, np.int64)
    smallest = np.full(n, np.iinfo(np.int64).max)
    last_bytes, level, x = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 3), np.int64)
    end_at = np.zeros(len(paths), np.int64)
    some_row = np.zeros(n, np.int64)
    for depth, (rows, at) in enumerate(zip(reached, places), 1):
        np.add.at(members, at, 1)
        np.minimum.at(smallest, at, (root_ids if depth == 1 else conv_ids)[rows])
        last_bytes[at] = turn_bytes[start[rows] + depth - 1]
        level[at], some_row[at] = depth, rows
        end_at[rows] = at
    np.maximum.at(x, end_at, extras)

    spine = np.zeros(n, bool)
    walks = [[at[i] for rows, at in zip(reached, places) for i in np.flatnonzero(rows == row)] for row in (0, len(paths) - 1)]
    for walk in walks:
        spine[walk] = True
    nodes = np.flatnonzero(level > 0)
    parent = trie.check
    inner = nodes[~spine[nodes]]
    children = np.zeros(n, np.int64)
    np.add.at(children, parent[inner], 1)
    n_children = children + x[:, 0]
    leaves = x[:, 1] + ((n_children == 0) & ~spine)
    saved = x[:, 2] + (members - 1) * last_bytes
    leaves[spine], saved[spine] = 0, 0
    for depth in range(len(reached), 1, -1):
        here = inner[level[inner] == depth]
        np.add.at(leaves, parent[here], leaves[here])
        np.add.at(saved, parent[here], saved[here])

    # members that end in a node are one run of rows
    stop = np.flatnonzero(ends)
    last = {}
    if len(stop):
        cuts = np.flatnonzero(np.diff(end_at[stop])) + 1
        for group in np.split(stop, cuts):
            last[int(end_at[group[0]])] = conv_ids[group]

    names: dict[int, bytes] = {}

    def name(node: int) -> bytes | None:
        if node not in names:
            names[node] = _digest(paths[some_row[node]][: KEY * int(level[node])])
        return names[node]

    none = _sha("")
    for node in inner.tolist():
        above = int(parent[node])
        far = bool(spine[above]) and level[above] > 0
        yield {
            "kind": "node", "parent": name(above) if far else None,
            "parent_conv_id": None if far or level[above] == 0 else int(smallest[above]),
            "layer_key": paths[some_row[node]][:KEY] if level[node] == 1 else None,
            "level": int(level[node]), "conv_id": int(smallest[node]), "n_convs": int(members[node]),
            "n_children": int(n_children[node]), "n_leaves": int(leaves[node]), "saved": int(saved[node]),
            "ends": _sha(_ids(last[node])) if node in last else none,
        }
    seen: set[int] = set()
    for side, walk in enumerate(walks):
        for node in map(int, walk):
            once = node not in seen
            seen.add(node)
            yield {
                "kind": "spine", "node": name(node), "parent": name(int(parent[node])) if level[node] > 1 else None,
                "layer_key": paths[some_row[node]][:KEY] if level[node] == 1 else None,
                "level": int(level[node]), "shard": shard, "side": side, "n_bytes": int(last_bytes[node]),
                "conv_id": int(smallest[node]), "n_convs": int(members[node]) * once,
                "n_children": int(children[node]) * once, "n_leaves": int(leaves[node]) * once,
                "saved": int(saved[node]) * once, "x_children": int(x[node, 0]),
                "x_leaves": int(x[node, 1]), "x_saved": int(x[node, 2]),
            }
            if once and node in last:
                ids = last[node]
                for part, first in enumerate(range(0, len(ids), LIST_IDS)):
                    yield {
                        "kind": "ends", "node": name(node), "shard": shard, "part": part,
                        "ends": _ids(ids[first : first + LIST_IDS]),
                    }


def _shards(shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            paths = batch.column("path").to_pylist()
            sizes = [np.asarray(s, np.int64) for s in batch.column("sizes").to_pylist()]
            conv_ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            root_ids = batch.column("root_id").to_numpy(zero_copy_only=False)
            ends = batch.column("ends").to_numpy(zero_copy_only=False)
            extras = np.stack(
                [batch.column(c).to_numpy(zero_copy_only=False) for c in ("x_children", "x_leaves", "x_saved")], axis=1
            )
            turns = np.cumsum([len(s) + 1 for s in sizes])
            first = 0
            while first < len(paths):
                before = turns[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(turns, before + shard_turns, side="right")))
                own = slice(first, stop)
                rows = list(
                    shard_rows(paths[own], sizes[own], conv_ids[own], root_ids[own], ends[own], extras[own], number)
                )
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=_ARROW)
                number += 1
                first = stop

    return run


def _list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash lists of members that arrive in pieces, sorted by node; memory holds one piece."""
    node, running = None, None
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for key, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if key != node:
                if node is not None:
                    done.append({"node": node, "ends_sha256": running.hexdigest()})
                node, running = key, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": running.hexdigest()}], schema=schema)


# one layer

def _layer(paths: DataFrame, shard_turns: int) -> DataFrame:
    """All nodes of the tries over `paths` (path, sizes, conv_id, root_id, ends, x_*)."""
    found = store(
        paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
        .mapInArrow(_shards(shard_turns), _SPARK),
        "shards",
    )
    spine = found.filter("kind = 'spine'")
    merged = spine.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("layer_key").alias("layer_key"), F.first("level").alias("level"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("own_children"), F.sum("n_leaves").alias("own_leaves"), F.sum("saved").alias("own_saved"),
        F.max("n_bytes").alias("n_bytes"), F.max("x_children").alias("x_children"), F.max("x_leaves").alias("x_leaves"),
        F.max("x_saved").alias("x_saved"), F.min(F.struct("shard", "side")).alias("owner"),
    )
    below = merged.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_spine"))
    merged = store(
        merged.join(below, F.col("node") == F.col("of"), "left")
        .withColumn("n_children", F.col("own_children") + F.coalesce("n_spine", F.lit(0)) + F.col("x_children"))
        .withColumn("add_leaves", F.col("own_leaves") + F.col("x_leaves") + (F.col("n_children") == 0).cast("long"))
        .withColumn("add_saved", F.col("own_saved") + F.col("x_saved") + (F.col("n_convs") - 1) * F.col("n_bytes")),
        "spine",
    )
    # A spine node counts once for itself and all nodes above it: on the path of its owner
    # these are the rows of smaller level, so the sums run up each path.
    up = Window.partitionBy("shard", "side").orderBy(F.desc("level"))
    walks = spine.select("node", "shard", "side", "level").join(
        merged.select(F.col("node").alias("of"), "owner", "add_leaves", "add_saved"), F.col("node") == F.col("of")
    )
    mine = F.col("owner") == F.struct("shard", "side")
    totals = (
        walks.select(
            "node",
            F.sum(F.when(mine, F.col("add_leaves")).otherwise(0)).over(up).alias("up_leaves"),
            F.sum(F.when(mine, F.col("add_saved")).otherwise(0)).over(up).alias("up_saved"),
        )
        .groupBy("node").agg(F.sum("up_leaves").alias("n_leaves"), F.sum("up_saved").alias("saved"))
    )
    hashes = (
        found.filter("kind = 'ends'").select("node", "shard", "part", "ends")
        .repartition("node").sortWithinPartitions("node", "shard", "part").select("node", "ends")
        .mapInArrow(_list_hashes, "node binary, ends_sha256 string")
    )
    names = merged.select(F.col("node").alias("above"), F.col("conv_id").alias("above_conv"))
    columns = [
        "conv_id", "level", "layer_key", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256",
    ]
    upper = (
        merged.drop("n_leaves", "saved").join(totals, "node").join(hashes, "node", "left")
        .join(names, F.col("parent") == F.col("above"), "left")
        .withColumn("parent_conv_id", F.col("above_conv"))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_sha(""))))
    )
    inner = found.filter("kind = 'node'").withColumnRenamed("ends", "ends_sha256")
    under = inner.filter("parent IS NOT NULL").drop("parent_conv_id").join(names, F.col("parent") == F.col("above"))
    return (
        inner.filter("parent IS NULL").select(columns)
        .union(under.withColumn("parent_conv_id", F.col("above_conv")).select(columns))
        .union(upper.select(columns))
    )


# conversations

def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn's role and text."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(F.encode(whole, "utf-8"), 256), 1, 2 * KEY))


def ordered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, pos, key, n_bytes): the turns of every conversation, numbered from 0."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    turns = (
        conversations.filter(F.col(conv).isNotNull())
        .select(
            F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
            turn_key(role_, text_).alias("key"), F.octet_length(text_).cast("long").alias("n_bytes"),
        )
        .groupBy("conv_id", "turn", "key").agg(F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))
    )
    placed = running_totals(turns, ["turn", "key"], {"pos": "n"}, ["conv_id"])
    places = F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)
    return placed.select("conv_id", F.explode(places).alias("pos"), "key", "n_bytes")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose head comes from another: every c takes the first h turns of
    c - c % 5 and then its own turns after its first h, h = crc32(decimal c) % 9.

    Returns the turns and (conv_id, n_turns) of every conversation, turnless ones too.
    """
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    donors = lengths.select(F.col("conv_id").alias("donor"), F.col("n_own").alias("n_donor"))
    plan = store(
        lengths.withColumn("donor", F.col("conv_id") - F.col("conv_id") % 5)
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9)
        .join(donors, "donor", "left")
        .withColumn("n_head", F.least("h", F.coalesce("n_donor", F.lit(0))))
        .withColumn("n_turns", F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))),
        "heads",
    )
    heads = (
        turns.filter("pos < 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "donor")
        .join(plan.select("donor", "conv_id", "n_head"), "donor").filter("pos < n_head")
        .select("conv_id", "pos", "key", "n_bytes")
    )
    tails = (
        turns.join(plan.select("conv_id", "h", "n_head"), "conv_id").filter("pos >= h")
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "key", "n_bytes")
    )
    return heads.union(tails), plan.select("conv_id", "n_turns")


def trie_nodes(
    turns: DataFrame, lengths: DataFrame, layer_turns: int = LAYER_TURNS, shard_turns: int = SHARD_TURNS
) -> DataFrame:
    """Nodes of the prefix trie of `turns` (conv_id, pos, key, n_bytes) over the conversations
    of `lengths` (conv_id, n_turns), one row each.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. Nothing but the number of layers reaches the driver; a
    conversation of n turns takes part in n / `layer_turns` layers.
    """
    cut = turns.select(
        "conv_id", F.floor(F.col("pos") / layer_turns).cast("int").alias("layer"), F.struct("pos", "key", "n_bytes").alias("turn")
    )
    whole = lengths.select("conv_id", F.lit(0).alias("layer"), F.lit(None).cast(cut.schema["turn"].dataType).alias("turn"))
    pieces = store(
        cut.union(whole).groupBy("conv_id", "layer").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .join(lengths, "conv_id")
        .select(
            "conv_id", "layer", F.expr("aggregate(turns, X'', (a, t) -> concat(a, t.key))").alias("keys"),
            F.col("turns.n_bytes").alias("sizes"),
            (F.col("n_turns") <= (F.col("layer") + 1) * layer_turns).alias("ends"),
        ),
        "paths",
    )
    deepest = pieces.agg(F.max("layer")).first()[0]
    if deepest is None:
        return _output(
            turns.sparkSession.createDataFrame(
                [], "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                "saved long, ends_sha256 string",
            )
        )
    layers, begin = [], None
    for layer in range(deepest + 1):
        rows = pieces.filter(F.col("layer") == layer)
        if begin is None:
            rows = rows.withColumns({"path": F.concat(F.lit(bytes(KEY)), "keys"), "root_id": F.col("conv_id")})
        else:
            rows = rows.join(begin, "conv_id").withColumn("path", F.concat("begin", "keys"))
        full = F.size("sizes") == layer_turns
        end_key = F.unhex(F.substring(F.sha2(F.col("path"), 256), 1, 2 * KEY))
        rows = rows.withColumn("end_key", F.when(full, end_key)).drop("keys")
        if deepest:
            rows = store(rows, "layer")
            smallest = rows.filter("end_key IS NOT NULL").groupBy(F.col("end_key").alias("begin")).agg(
                F.min("conv_id").alias("root_id")
            )
            begin = rows.filter("NOT ends").select("conv_id", F.col("end_key").alias("begin")).join(smallest, "begin")
        layers.append(rows)
    out, under = None, None
    for layer, rows in reversed(list(enumerate(layers))):
        extra = ("x_children", "x_leaves", "x_saved")
        if under is not None:
            none = {c: F.lit(0).cast("long") for c in extra}
            full = rows.filter("end_key IS NOT NULL").join(under, "end_key", "left")
            rows = full.unionByName(rows.filter("end_key IS NULL").withColumns(none))
        else:
            rows = rows.withColumns({c: F.lit(0).cast("long") for c in extra})
        nodes = _layer(
            rows.select("path", "sizes", "conv_id", "root_id", "ends", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in extra]),
            shard_turns,
        )
        nodes = store(nodes, "nodes") if deepest else nodes
        under = nodes.filter("level = 1").select(
            F.col("layer_key").alias("end_key"), F.col("n_children").alias("x_children"),
            F.col("n_leaves").alias("x_leaves"), F.col("saved").alias("x_saved"),
        )
        mine = (nodes if layer == 0 else nodes.filter("level > 1")).withColumn("depth", F.col("level") - 1 + layer * layer_turns)
        out = mine if out is None else out.union(mine)
    return _output(out)


def _output(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "conv_id", F.col("depth").cast("long"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def conversation_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", rebuild: bool = True, layer_turns: int = LAYER_TURNS, shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """One row per distinct sequence of first turns, the textless root included.

    Conversations are ordered by turn, null first; turns of equal number by their key (the
    hash of role and text). Repeated rows are turns of their own. A null role or text is
    empty. Rows without a conversation id take no part. Texts enter as hashes, whole, of any
    length. A conversation may be of any length and may be left turnless by `rebuild`; it is
    then a member of the root. Other columns are ignored, whatever their names. An empty
    table has no node.
    """
    turns = ordered_turns(conversations, conv, turn, role, text)
    if rebuild:
        turns, lengths = rebuilt_turns(store(turns, "turns"))
    else:
        turns = store(turns, "turns")
        lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return trie_nodes(turns, lengths, layer_turns, shard_turns)
