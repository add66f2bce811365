"""Registered training-data queries: against their SQL where they have it, else against
plain Python over the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import connect, differences

import __spark_entry__ as entry
from agentlog.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    assert differences(df, connect(sf_dir), queries.ORACLE_SQL[name]) == []


def test_all_registered():
    found = entry.queries()
    assert "pipeline" in found
    assert {int(n[2:].split("_")[0]) for n in found if re.match(r"op\d+_", n)} == set(range(1, 14))


def test_op1(spark, sf_dir, documents):
    p = entry.queries()["op1_two_pass_shuffle"](spark, sf_dir).toPandas()
    assert sorted(p.doc_id) == sorted(documents)
    counts = p.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert set(p["shard"]) <= set(range(24)) and counts["size"].max() - counts["size"].min() <= 1
    assert (counts["max"] + 1 == counts["size"]).all() and (counts["nunique"] == counts["size"]).all()
    for i, size, crc in zip(p.doc_id, p["size"], p.text_crc32):
        raw = documents[i].encode()
        assert (size, crc) == (len(raw) + 8, zlib.crc32(raw))


def test_op2(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    p = entry.queries()["op2_pack_sequences"](spark, sf_dir).toPandas()
    by_doc = {i: g.sort_values("piece") for i, g in p.groupby("doc_id")}
    assert set(by_doc) == set(documents)
    for i, g in by_doc.items():
        ids = np.array([*tokenizer.encode(documents[i], add_special_tokens=False).ids, 0], "<u4")
        parts = [ids[at : at + 2048] for at in range(0, len(ids), 2048)]
        assert list(zip(g.piece, g.start, g.length, g.ids_crc32)) == [
            (k, 2048 * k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(parts)
        ]
    bins = p.sort_values("offset").groupby("sequence_id")
    assert bins.length.sum().max() <= 2048
    assert all((g.offset == g.length.cumsum() - g.length).all() for _, g in bins)
    assert bins.ngroups <= 1.02 * -(-p.length.sum() // 2048) + 1


def test_op6(spark, sf_dir, documents):
    """Classes of lines equal the components of all pairs of lines, by shingles of every
    ten characters."""
    places = collections.defaultdict(list)
    for i in sorted(documents):
        for no, line in enumerate(documents[i].split("\n")):
            flat = re.sub("[ \t\x0b\x0c\r]+", " ", line).strip(" ")
            if flat:
                places[flat].append((i, no))
    lines = list(places)
    sets = [frozenset(line[k : k + 10] for k in range(max(1, len(line) - 9))) for line in lines]
    root = components(
        len(lines),
        ((a, b) for a in range(len(lines)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8),
    )
    first = {}
    for k, line in enumerate(lines):
        first[root[k]] = min(first.get(root[k], places[line][0]), places[line][0])
    expected = {place: first[root[k]] for k, line in enumerate(lines) for place in places[line]}
    p = entry.queries()["op6_fuzzy_lines"](spark, sf_dir).toPandas()
    got = {(i, no): (c, n) for i, no, c, n in zip(p.doc_id, p.line_no, p.class_id, p.class_line)}
    assert got == expected
    assert p.kept.sum() == len(set(expected.values()))


def test_op8(spark, sf_dir, documents):
    """Near documents of all pairs share a class, and every class is joined by such pairs."""
    ids = sorted(documents)
    words = [WORD.findall(documents[i]) for i in ids]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in words]
    root = components(
        len(ids), ((a, b) for a in range(len(ids)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8)
    )
    p = entry.queries()["op8_near_duplicates"](spark, sf_dir).toPandas()
    got = dict(zip(p.doc_id, p.class_id))
    assert got == {i: ids[root[k]] for k, i in enumerate(ids)}
    assert (p.groupby("class_id").kept.sum() == 1).all()


def test_op9(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    expected = {}
    for i, page in zip(pages.page_id, pages.html):
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        blocks = [html.unescape(re.sub(r"</?b>|<br>", "", b)) for b in re.split(r"</?(?:p|h1)>", inner)]
        expected[i] = "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)
    p = entry.queries()["op9_wrapper_text"](spark, sf_dir).toPandas()
    assert dict(zip(p.page_id, p.text)) == expected
    assert (p.n_chars == p.text.str.len()).all()


def test_op10(spark, sf_dir, documents):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    p = entry.queries()["op10_secrets"](spark, sf_dir).toPandas().set_index("doc_id")
    for i, text in documents.items():
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        base = [x[2] for x in sorted(found)]
        row = p.loc[i]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in row.spans.split(",") if s and not s.startswith("guess")] == base
        assert row.n_assign + row.n_access + row.n_hex == len(base)


def jaccard(a, b):
    common = len(a & b)
    return common / (len(a) + len(b) - common) if common else 0.0


def components(n, links):
    """Smallest connected number of each number."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
