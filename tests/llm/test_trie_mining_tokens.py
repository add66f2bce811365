"""Prefix tries, hard negatives and token files against brute force and round trips."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from agentlog.llm import mining, tokenfile, trie

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# op11

def plain_trie(rows, rebuild=True):
    """All nodes by listing every prefix of every conversation."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            turns[conv].append((turn is not None, turn or 0, key, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        head = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h]
        whole[c] = head + own[c][h:] if rebuild else own[c]
    members = collections.defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    children = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in members}
    out = set()
    for p, own_members in members.items():
        ends = ",".join(str(c) for c in sorted(own_members) if len(whole[c]) == len(p))
        out.add(
            (
                min(own_members), len(p), min(members[p[:-1]]) if p else None, len(own_members), len(children[p]),
                sum(not children[q] for q in below[p]),
                sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return out


def conversations(spark, rows):
    schema = "conv_id long, turn long, role string, text string, pos string, level string, node string, key string"
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)


def some_conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, n):
        for t in range(rng.choice([0, 1, 2, 3, 6, 9, 14])):
            text = rng.choice(["ä long turn", "b", "c", "", None, "日本"])
            if t < 2:
                text = "hello"  # a common head
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", None]), text))
    rows += rng.sample(rows, 5)  # repeated rows
    rows += [(None, 0, "user", "nobody")]
    rows += [(c, t, "user", f"line {t}") for c in range(500, 540) for t in range(8)]  # copies
    return rows


@pytest.mark.parametrize("rebuild,layer,shard", [(True, 512, 200_000), (True, 4, 30), (False, 3, 7), (False, 512, 20)])
def test_trie_equals_listing(spark, rebuild, layer, shard):
    rows = some_conversations(layer, 60)
    got = trie.conversation_trie(conversations(spark, rows), rebuild=rebuild, layer_turns=layer, shard_turns=shard)
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows, rebuild)


def test_trie_of_long_conversation(spark):
    rows = [(c, t, "user", str(t)) for c, n in ((1, 90), (2, 60), (3, 61)) for t in range(n)]
    got = trie.conversation_trie(conversations(spark, rows), rebuild=False, layer_turns=20, shard_turns=1)
    assert {tuple(r) for r in got.collect()} == plain_trie(rows, False)


def test_trie_empty(spark):
    assert trie.conversation_trie(conversations(spark, [])).count() == 0
    assert trie.conversation_trie(conversations(spark, [(None, 1, "a", "b")])).count() == 0


def test_double_array_holds_all_children():
    rng = np.random.default_rng(0)
    array, children, nodes = trie.DoubleArray(4), {}, [0]
    for _ in range(300):
        node = nodes.pop(int(rng.integers(len(nodes))))
        codes = np.unique(rng.integers(0, 200, int(rng.integers(1, 12))))
        array.add(node, codes)
        for code, child in zip(codes, array.step(np.full(len(codes), node), codes)):
            children[node, int(code)] = int(child)
            nodes.append(int(child))
    assert len(set(children.values())) == len(children)
    for (node, code), child in children.items():
        assert array.step(np.array([node]), np.array([code]))[0] == child
    with pytest.raises(KeyError):
        array.step(np.array([0]), np.array([next(c for c in range(200) if (0, c) not in children)]))


# op12

def plain_negatives(rows):
    """(anchor, positive, rank, negative, scores) by scoring every pair of rows."""
    kept = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        kept.append((n, i, [int(np.floor(256 * x)) for x in v], label))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    last = 2**63 - 1
    out = []
    for n, i, v, label in kept:
        if i is None or i % 100:
            continue
        scored = [(-score(v, w), last if j is None else j, m, j, other) for m, j, w, other in kept if m != n]
        for ps, _, _, j, _ in sorted(x[:3] + x[3:] for x in scored if x[4] == label)[:5]:
            ps = -ps
            fits = sorted(x[:3] for x in scored if x[4] != label and 30 * ps <= -100 * x[0] <= 90 * ps)[:10]
            for rank, (s, neg, _) in enumerate(fits, 1):
                out.append((i, j, rank, None if neg == last else neg, ps, -s))
    return sorted(out, key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int, row string, score string, list string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def some_vectors(dims, scale=1.0, n=400):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(4, dims))
    rows = []
    for i in range(n):
        v = (centres[i % 4] + rng.normal(size=dims) * 0.7) * scale
        rows.append((i, v.tolist(), int(rng.integers(0, 3))))
    rows += [(1000 + i, rows[3][1], 1) for i in range(150)]  # copies of one vector
    rows += [(100, rows[5][1], 0), (7, rows[7][1], 2)]  # an id twice
    rows += [(2000, None, 1), (2100, rows[1][1], None), (2200, [None] * dims, 1), (2300, [float("nan")] * dims, 1),
             (2400, [float("inf")] * dims, 0), (None, rows[9][1], 2), (2500, rows[9][1][:-1], 1), (2600, [], 2)]
    return rows


@pytest.mark.parametrize("dims,scale", [(2, 1.0), (16, 1.0), (3, 1e6), (3, 1e-4)])
def test_negatives_equal_all_pairs(spark, dims, scale):
    rows = some_vectors(dims, scale)
    got = mining.hard_negatives(vectors(spark, rows), leaf_rows=8, tree_bytes=3000, chunk_bytes=200)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_negatives(rows)


def test_negatives_beyond_a_long(spark):
    rows = [(0, [1e15, 3.0], 0), (1, [1e15, 2.0], 0), (2, [5e14, 1.0], 1), (3, [1e300, 1.0], 1)]
    got = [tuple(r) for r in mining.hard_negatives(vectors(spark, rows)).collect()]
    assert got == []  # the positive's score is held at the end of a long, below all others
    assert mining.hard_negatives(vectors(spark, [])).count() == 0
    assert mining.hard_negatives(vectors(spark, [(0, [1.0], 0), (1, [1.0], 0)])).count() == 0


def test_boxes_are_pruned():
    """Near rows are found without reading most leaves."""
    rng = np.random.default_rng(1)
    points = np.floor(rng.uniform(-1000, 1000, (4000, 2)))
    tree = mining.Tree(points, np.arange(4000), np.zeros(4000), np.arange(4000), leaf_rows=16, fanout=8)
    query = np.array([[700.0, -300.0]])
    best = mining.Best(5)
    read = mining.search(tree, tree.intervals(query), 0, query[0], np.ones(4000, bool), [best])
    scores = points @ query[0]
    assert best.id.tolist() == np.lexsort((np.arange(4000), -scores))[:5].tolist()
    assert read < len(tree.levels[0].least_id) / 10
    window = mining.Best(5, 1000.0, 2000.0)
    mining.search(tree, tree.intervals(query), 0, query[0], np.ones(4000, bool), [window])
    fits = np.flatnonzero((scores >= 1000) & (scores <= 2000))
    assert window.id.tolist() == fits[np.lexsort((fits, -scores[fits]))][:5].tolist()


# op13

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_op13(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in entry.queries()["op13_token_files"](spark, sf_dir).collect()}
    start, want = 0, {}
    for r in docs:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_token_files_awkward(spark, awkward, tokenizer, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(awkward, path, VOCABULARY, 1, block_ids=1000, section_ids=64, lanes=8)
    got = tokenfile.read_tokens(spark, path, keep_ids=True).orderBy("start").collect()
    expected = collections.Counter()
    for r in awkward.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[r.doc_id, ids.tobytes()] += 1
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == expected
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])][:-1].tolist()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    stream = b"".join(bytes(r.ids) for r in got)
    for first, stop in ((0, 5), (997, 1003), (2500, 2500), (len(stream) // 4 - 3, len(stream) // 4 + 9), (100, 9000)):
        parts = sorted(map(tuple, tokenfile.read_range(spark, path, first, stop).collect()))
        assert b"".join(bytes(p) for _, p in parts) == stream[4 * first : 4 * stop]


def test_token_files_empty(spark, empty, tmp_path):
    tokenfile.write_tokens(empty, f"file://{tmp_path}/none", VOCABULARY, 1)
    assert tokenfile.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n,kinds", [(0, 5), (1, 1), (7, 2), (5000, 1), (5000, 40_000), (20_000, 300)])
def test_coder_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, kinds, n) * rng.random(n)).astype(np.uint32)
    freq = tokenfile.normalised(np.bincount(np.r_[ids, 0].astype(int), minlength=kinds))
    assert freq.sum() == 1 << tokenfile.PRECISION
    coder = tokenfile.Coder(freq, lanes=16)
    block = coder.encode(ids, section_ids=256)
    assert (coder.decode(block) == ids).all()
    for first, stop in ((0, 1), (255, 257), (1000, 3000), (n - 1, n + 5)):
        assert (coder.decode(block, max(0, first), stop) == ids[max(0, first) : stop]).all()
    if kinds > 1 and n > 1000:
        broken = bytearray(block)
        broken[-5] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(broken))
        with pytest.raises(ValueError):
            coder.decode(block[:-4])


def test_rare_ids_cost_more():
    """The code is close to the entropy of its ids."""
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.05, 300_000), 500).astype(np.uint32)
    counts = np.bincount(ids)
    share = counts[counts > 0] / counts.sum()
    bits = -(share * np.log2(share)).sum() * len(ids)
    block = tokenfile.Coder(tokenfile.normalised(counts)).encode(ids)
    states = 8 * tokenfile.LANES * -(-len(ids) // tokenfile.SECTION_IDS)
    assert len(block) - states < 1.01 * bits / 8 + 200


def test_joined_checksums():
    rng = random.Random(5)
    for n in (0, 1, 4, 1000, 12_345):
        a, b = rng.randbytes(77), rng.randbytes(n)
        assert tokenfile.crc_of_joined(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)
