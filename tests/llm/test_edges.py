"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agentlog.llm import exact, html, lines, mixing, neardup, packing, quality, rounds, secrets, sharding, urls
from agentlog.llm.components import components

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PROSE = " ".join(f"word{i}" for i in range(60)) + "."


def shuffled(df):
    return sharding.two_pass_shuffle(df, sharding.row_bytes(F.col("text")), 3, 7, bucket_bytes=4096)


def mixed(df):
    sized = df.withColumn("size", F.length("text").cast("long")).withColumn(
        "key", mixing.hash_key(1, F.col("doc_id"), F.col("text"))
    )
    return mixing.mix(sized, "source", "size", "key")


OPERATORS = {
    "sharding": shuffled,
    "packing": lambda df: packing.pack(packing.token_pieces(df, VOCABULARY)),
    "mixing": mixed,
    "quality": quality.clean,
    "exact": exact.exact_dedup,
    "lines": lines.line_classes,
    "near": neardup.near_duplicates,
    "secrets": lambda df: secrets.scan(df, VOCABULARY),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    out = OPERATORS[name](empty)
    assert out.count() == 0 and len(set(out.columns)) == len(out.columns)


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"lines", "packing"}))
def test_every_row_once(awkward, name):
    out = OPERATORS[name](awkward)
    assert len(set(out.columns)) == len(out.columns)
    count = collections.Counter(r[0] for r in out.select("doc_id").collect())
    assert count == collections.Counter(r[0] for r in awkward.select("doc_id").collect())


def test_sharding_rows_law(awkward):
    p = shuffled(awkward).select("doc_id", "shard", "slot").toPandas()
    assert sorted(p.groupby("shard").slot.apply(lambda s: tuple(sorted(s)))) == [(0, 1, 2), (0, 1, 2, 3), (0, 1, 2, 3)]


def test_sharding_spreads_repeated_rows(spark):
    rows = spark.range(2000).select(F.lit(1).alias("doc_id"), F.lit("same text").alias("text"))
    out = sharding.two_pass_shuffle(rows, F.lit(100), 4, 1, bucket_bytes=20_000)
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [500] * 4


def test_shuffle_is_uniform_and_repeatable(spark):
    rows = spark.range(1000).withColumnRenamed("id", "doc_id")
    order = [
        [r[0] for r in sharding.two_pass_shuffle(rows, F.lit(64), 1, s, 8000).orderBy("slot").collect()]
        for s in (1, 1, 2)
    ]
    assert order[0] == order[1] != order[2]
    assert abs(np.corrcoef(np.arange(1000), order[0])[0, 1]) < 0.15


def test_packing_awkward(awkward):
    p = packing.pack(packing.token_pieces(awkward, VOCABULARY, 64), 64).toPandas()
    assert p.groupby("sequence_id").length.sum().max() <= 64
    assert (p[p.doc_id == 1].length == 1).all()  # only the end token


def test_packing_ids_round_trip(spark):
    df = spark.createDataFrame([(1, "one two three " * 50), (2, "")], "doc_id long, text string")
    rows = packing.token_pieces(df, VOCABULARY, 32, keep_ids=True).orderBy("doc_id", "start").collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    for i, text in ((1, "one two three " * 50), (2, "")):
        ids = [x for r in rows if r.doc_id == i for x in r.ids]
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_encoder_equals_tokenizer():
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in [*range(9, 14), *range(28, 0x260), *range(0x2010, 0x2040), 0x65E5, 0x301]]
    encoder = packing.DocumentEncoder(VOCABULARY)
    texts = ["".join(rng.choice(letters, 80)) for _ in range(300)] + [
        "it's we'll 'S 'T o'clock ... a., b.", "<|endoftext|> x", "é É ΣΑΣ İ ½² _a_", "a\x7fb \x1c c\xa0d",
    ]
    for text in texts:
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_swaps_reduce_bins():
    rng = np.random.default_rng(0)
    sizes = rng.integers(300, 1400, 1000)
    start = packing.Bins(sizes, 2048)
    before = len(start.items)
    number, offset = packing.pack_group(sizes, 2048)
    assert number.max() + 1 < before
    for b in range(number.max() + 1):
        here = np.flatnonzero(number == b)
        here = here[np.argsort(offset[here])]
        assert offset[here].tolist() == (np.cumsum(sizes[here]) - sizes[here]).tolist()
        assert sizes[here].sum() <= 2048


def test_mixing_budgets(spark):
    rows = [(i, "abcdefghij"[i % 4] if i % 5 else None, 1 + i % 7, i * 7919 % 1000) for i in range(400)]
    rows += [(1000, "z", 4, 5)] * 90  # repeated rows at the cut
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, key long")
    p = mixing.mix(df, "source", "size", "key").toPandas()
    assert (p.taken <= 3 * p["size"]).all()
    assert abs(p.groupby("source", dropna=False).target.first().sum() - p["size"].sum()) < 1e-6
    for _, g in p.groupby("source", dropna=False):
        assert g["size"].sum() == g.source_size.iloc[0]
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    whole = mixing.mix(df, "source", "size", "key", whole=True).toPandas()
    assert (whole.taken == whole.repeats * whole["size"]).all()
    for _, g in whole.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 7


def test_quality_lines(spark):
    nav = "Home | News | About | Contact | Help"
    df = spark.createDataFrame(
        [(1, f"{PROSE}\n{nav}\nAll rights reserved."), (2, f"{nav}\n{nav} |\nshort"), (3, None), (4, (PROSE + "\n") * 2)],
        "doc_id long, text string",
    )
    rows = {r.doc_id: r for r in quality.clean(df).collect()}
    assert rows[1].kept and rows[1].clean_text == PROSE and rows[1].n_failed_lines == 2
    assert not rows[2].kept
    assert rows[3].base_failed and rows[3].n_words == 0 and rows[3].clean_text == ""
    assert rows[4].n_dup_lines == 1 and rows[4].n_repeat_words == 120 and rows[4].base_failed


def test_exact_awkward(awkward):
    rows = exact.exact_dedup(awkward).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in groups.values())
    prose = next(g for g in groups.values() if any(r.doc_id == 5 for r in g))
    assert len(prose) == 4 and {r.keep_id for r in prose} == {5}


def test_exact_divides_collisions(awkward):
    """With a prime of 2 nearly all texts of one length collide; results stay the same."""
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    expected = exact.exact_dedup(awkward).select(columns).collect()
    weak = exact.exact_dedup(awkward, chunk_bytes=1000, prime=2).select(columns).collect()
    assert sorted(map(repr, weak)) == sorted(map(repr, expected))


def test_fingerprints_compose():
    data = bytes(range(256)) * 30
    whole = exact.fingerprint(data, 1 << 20)
    assert whole == exact.fingerprint(data, 7)
    left, right = exact.fingerprint(data[:999]), exact.fingerprint(data[999:])
    assert exact.combine(left, right) == whole


def test_near_duplicates_keep_one(awkward):
    rows = neardup.near_duplicates(awkward).collect()
    classes = collections.defaultdict(list)
    for r in rows:  # here classes are equal texts; two texts share the id 9
        classes[r.text_key].append(r)
    assert sorted(len(g) for g in classes.values()) == [1, 1, 1, 1, 3, 4]
    assert all(sum(r.kept for r in g) == 1 for g in classes.values())
    kept = neardup.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(classes)


def near_copies(n, words, seed=0):
    """Copies of one text with a few changed words each."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for at in rng.choice(words, rng.integers(0, 6), replace=False):
            copy[at] = f"x{i}_{at}"
        out.append((i, " ".join(copy)))
    return out


def test_large_bucket_loses_no_link(spark):
    """One large group of near copies: classes equal those of all pairs."""
    rows = near_copies(400, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_order_matters():
    words = neardup.WordHashes()
    a = neardup.labelled_kmers(" ".join(f"w{i}" for i in range(200)), 5, words)
    b = neardup.labelled_kmers(" ".join(f"w{(i + 100) % 200}" for i in range(200)), 5, words)
    assert len(np.intersect1d(a, b)) >= 190
    assert neardup.aligned_similarity(a, b, 0.8) < 0.8 < neardup.aligned_similarity(a, a, 0.8)


def test_components_of_a_path(spark):
    links = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    far = spark.createDataFrame([(100, 101)], "a long, b long")
    got = dict(components(links.union(far)).collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_lines_awkward(awkward):
    rows = lines.line_classes(awkward).collect()
    assert len(rows) == 8  # documents 1 to 3 have no word
    prose = [r for r in rows if r.class_size == 4]
    assert len(prose) == 4 and sum(r.kept for r in prose) == 1 and {r.class_id for r in prose} == {5}


def test_fuzzy_lines_and_removal(spark):
    line = " ".join(f"term{i}" for i in range(40))
    near = line.replace("term20", "other")
    df = spark.createDataFrame([(1, f"{line}\nunique one here"), (2, f"{near}\n\nsecond text")], "doc_id long, text string")
    classes = lines.line_classes(df)
    assert {(r.doc_id, r.line_no): r.kept for r in classes.collect()} == {(1, 0): True, (1, 1): True, (2, 0): False, (2, 2): True}
    out = {r.doc_id: r.text for r in lines.drop_repeated_lines(df, classes).collect()}
    assert out == {1: f"{line}\nunique one here", 2: "\nsecond text"}


def test_long_words_are_read_to_their_end(spark):
    """Lines of times, numbers and texts without spaces: classes equal those of all pairs by
    shingles of every character."""
    texts = ["2024-01-15T10:22", "2024-01-15T23:59", "user_00000000001", "user_00000000002", "user_00000000002 ok"]
    texts += ["一二三四五六七八九十甲乙丙", "一二三四五六七八九十丁戊己庚", "一二三四五六七八九十"]
    texts += [f"https://example.org/path/item-{x}" for x in ("aaaaaa", "bbbbbb")]
    texts += [f"{'0123456789' * 6}{x}" for x in "ab"]
    texts += ["time 2024-01-15T10:22 by user_00000000001", "time 2024-01-15T23:59 by user_00000000001"]
    sets = [{t[i : i + 10] for i in range(max(1, len(t) - 9))} for t in texts]
    expected = [
        next(a for a in range(b + 1) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])) for b in range(len(sets))
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in lines.line_classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_line_minima_are_independent(spark):
    """Of 2,000 pairs at Jaccard exactly 0.8, 0.3% share no band; no more may be lost."""
    rng = np.random.default_rng(5)
    rows = []
    for pair in range(2000):
        words = [f"{x:010d}" for x in rng.choice(10**10, 10, replace=False)]
        rows += [(2 * pair, " ".join(words[:9])), (2 * pair + 1, " ".join(words[:8] + words[9:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = lines.line_classes(df).collect()
    assert all(r.class_id in (r.doc_id, r.doc_id - 1) for r in classes)
    assert sum(r.kept for r in classes) - 2000 <= 16  # 6.4 expected


def test_urls(spark):
    rules = [urls.Rule("com", "/", "allow"), urls.Rule("bad.com", "/x/", "block")]
    pages = spark.createDataFrame(
        [(1, "http://A.bad.COM/x/1?q"), (2, "https://good.com?x"), (3, None), (4, "no scheme"), (5, "http://spam.org/a"), (6, "http://new.spam.org#f")],
        "page_id long, url string",
    ).withColumn("verdict", F.lit("clash"))
    outcomes = spark.createDataFrame(
        [("spam.org", 1)] * 60 + [("fine.net", 0)] * 200 + [("good.com", 0)] * 50 + [("good.com", None)], "host string, bad int"
    )
    rows = {r.page_id: r for r in urls.filter_urls(pages, outcomes, rules).collect()}
    assert (rows[1].host, rows[1].path, rows[1].rule, rows[1].verdict) == ("a.bad.com", "/x/1", "bad.com/x/", "block")
    assert (rows[2].path, rows[2].rule, rows[2].verdict) == ("", None, "allow")
    assert (rows[3].host, rows[3].path, rows[4].host) == ("", "", "")
    assert rows[5].verdict == "block" and rows[6].bad_mean > rows[2].bad_mean
    assert urls.filter_urls(pages.limit(0), outcomes.limit(0), rules).count() == 0


def test_wrapper(spark):
    def page(i, body):
        return f"<html><body><div>Welcome to our site</div><div id=c><h2>Title {i}</h2><p>{body}</div><p>Call us today</body></html>"

    rows = [(i, "http://h.example.org/a", page(i, f"Body &amp; text {i}.")) for i in range(6)]
    rows += [(10, "http://other.example.org/", None), (11, None, ""), (12, "http://x/", "<p>a<br>b\n c<script>x</script>"), (12, "http://x/", "<p>a<br>b\n c<script>x</script>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert [got[i] for i in range(6)] == [f"Title {i}\n\nBody & text {i}." for i in range(6)]
    assert (got[10], got[11], got[12]) == ("", "", "a b c")
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["article", "div"])
def test_copies_of_a_long_page_are_no_template(spark, tag):
    """A reference of 16 paragraphs, four copies with another advert, many shorter pages."""

    def page(advert, blocks):
        body = "".join(f"<p>{b}</p>" for b in blocks)
        return f"<html><body><div>Site name</div><{tag}>{body}</{tag}><div>{advert}</div></body></html>"

    long = [f"Long paragraph {k}." for k in range(16)]
    blocks = {i: long for i in range(5)}
    blocks |= {i: [f"Page {i} paragraph {k}." for k in range(3 + i % 8)] for i in range(5, 60)}
    df = spark.createDataFrame([(i, "http://h.org/a", page(f"Advert {i}", b)) for i, b in blocks.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in html.extract(df).collect()}
    advert = (lambda i: []) if tag == "article" else (lambda i: [f"Advert {i}"])
    assert got == {i: b + advert(i) for i, b in blocks.items()}


def test_main_text_regions():
    page = html.parse(
        '<body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav><main><article><header><h1>T</h1></header>'
        "<div class=share-bar>Share</div><p>One<p>Two <i>x</i></p><form>f</form><!-- c --></article>"
        '<section id="comments"><p>reader</section></main><aside>s</aside><div class="cookie-notice">n</div><footer>f'
    )
    assert html.main_text(page, set()) == "T\n\nOne\n\nTwo x"


def test_tree_matching_is_optimal():
    """Against plain simple tree matching on random trees."""
    rng = np.random.default_rng(1)

    def tree(depth):
        node = html.Node("abc"[rng.integers(3)])
        if depth:
            node.children = [tree(depth - 1) for _ in range(rng.integers(0, 4))]
        return node

    def plain(a, b):
        if a.tag != b.tag:
            return 0
        m = np.zeros((len(a.children) + 1, len(b.children) + 1), int)
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                m[i + 1, j + 1] = max(m[i, j + 1], m[i + 1, j], m[i, j] + plain(x, y))
        return m[-1, -1] + 1

    matcher = html.Matcher()
    for _ in range(200):
        a, b = tree(3), tree(3)
        matcher.measure(a)
        matcher.measure(b)
        assert matcher.weight(a, b) == plain(a, b)


def test_secrets(spark):
    df = spark.createDataFrame(
        [(1, "my pwd is x8Kq!2vL, ok"), (2, "the password is wrong"), (3, "http://u:p@9zQ!x1KvB@h/ token=abcdefgh1"), (4, None), (5, "token=abc token: AKIA" + "Z" * 16)],
        "doc_id long, text string",
    )
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(df, VOCABULARY).collect()}
    assert spans[1] == [("guess", 10, 18)] and spans[2] == [] and spans[4] == []
    assert ("assign", 24, 39) in spans[3]
    assert [s[0] for s in spans[5]] == ["assign", "access"]


def test_guess_costs():
    cost = secrets.Guesser(secrets.word_ranks(VOCABULARY)).cost
    assert cost("password") < cost("Password1") < cost("x8Kq!2vL")
    assert cost("qwertyuiop") < 4 and cost("aaaaaaaaaaaa") < 4 and cost("12/05/1990") < 6
    assert cost("") == 0


def test_exact_dedup_with_clashing_names(spark):
    rows = [(1, "a  b", "x"), (2, "a b", "y"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha256 string")
    for name in ("n_bytes", "fp", "__fp", "__bytes", "__print", "__row"):
        docs = docs.withColumn(name, F.lit("mine"))
    out = exact.exact_dedup(docs)
    assert set(docs.columns) < set(out.columns)
    found = {r.doc_id: (r.keep_id, r.kept, r.sha256, r.fp, r["__fp"]) for r in out.collect()}
    assert found == {
        1: (1, True, "x", "mine", "mine"), 2: (1, False, "y", "mine", "mine"), 3: (3, True, "z", "mine", "mine"),
    }


def _cheapest(guesser, value, at=0):
    """Least cost over every segmentation, by plain recursion."""
    if at == len(value):
        return 0.0
    low = value.lower()
    plain = low.translate(secrets.LEET)
    end = at + 1
    while end < len(value) and value[end] == value[at]:
        end += 1
    ways = [secrets._brute(value[at]) + _cheapest(guesser, value, at + 1)]
    for stop, cost in guesser._segments(value, low, plain, end, at):
        ways.append((0.3 if at else 0.0) + cost + _cheapest(guesser, value, stop))
    return min(ways)


@pytest.mark.parametrize("value", ["aaaa1999", "Passw0rd12", "qwerty99x", "zzzxxx", "日本語xyz", "hello2world"])
def test_guess_cost_is_the_least_over_all_segmentations(value):
    guesser = secrets.Guesser(secrets.word_ranks(VOCABULARY))
    assert guesser.cost(value) == pytest.approx(_cheapest(guesser, value))


def test_guess_cost_of_long_runs_is_linear():
    guesser = secrets.Guesser(secrets.word_ranks(VOCABULARY))
    assert secrets._run_ends("aabccc") == [2, 2, 3, 6, 6, 6]
    assert guesser.cost("*" * 200_000) < 8  # quadratic work would not end


def test_packing_many_short_pieces():
    """Sequences of a long and very many one-token pieces: equal sizes are tried once."""
    sizes = np.array([1100] * 300 + [1] * 3000)
    number, offset = packing.pack_group(sizes, 2048)
    fill = np.bincount(number, weights=sizes)
    assert fill.max() <= 2048 and fill.sum() == sizes.sum() and len(fill) == 300
    assert len(set(zip(number.tolist(), offset.tolist()))) == len(sizes)


@pytest.mark.parametrize(
    "drawing",
    [
        '<svg class="i"/>', "<svg><path d='M0'/>", "<math><mi>x</mi>", "<svg><text>no</text></svg>",
        "<svg><foreignObject><div>no</div></foreignObject></svg>", "<noscript><img src=x></noscript>",
        "<template><b>no</b></template>",
    ],
)
def test_drawings_take_no_text_with_them(drawing):
    page = html.parse(f"<article><p>Before.</p>{drawing}<p>After one.</p><p>Last.</p></article>")
    assert html.main_text(page, set()) == "Before.\n\nAfter one.\n\nLast."


def test_line_methods_against_plain_python(monkeypatch):
    """Shingles, pieces of long lines, comparisons and block links against sets of strings."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc ä😀") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [t[:-1] + "z" for t in texts[:20]] + ["short", "ab", "same line of text", "same line of text"]
    sets = [{t[i : i + 10] for i in range(max(1, len(t) - 9))} for t in texts]
    hashes, sizes = lines.shingles(texts, 10)
    parts = np.split(hashes, np.cumsum(sizes)[:-1])
    assert [len(set(p.tolist())) for p in parts] == [len(s) for s in sets]
    rules = lines.LineRules(columns=16)
    near = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    n = len(texts)
    got = lines.similar([t for t in texts for _ in texts], texts * n, rules)
    assert got.tolist() == [x for row in near for x in row]

    links = lines.linked_lines([(i, i, t) for i, t in enumerate(texts)], rules)
    root = list(range(n))
    for a, b in links:
        root = [root[a] if r == root[b] else r for r in root]
    expected = list(range(n))
    for a in range(n):
        for b in range(a):
            if near[a][b]:
                expected = [expected[b] if r == expected[a] else r for r in expected]
    assert len(set(zip(root, expected))) == len(set(root)) == len(set(expected)) == n - len(links)

    whole = lines.bucket_numbers(texts, rules)
    monkeypatch.setattr(lines, "CHUNK", 7)
    assert (lines.bucket_numbers(texts, rules) == whole).all()


def test_bands_find_similar_lines():
    """Of pairs at 0.8 a share near 0.997 meets in a band, in short and in long lines."""
    rng = random.Random(6)
    rules = lines.LineRules()
    left, right = [], []
    for _ in range(3000):
        size = rng.choice([40, 100, 300])
        text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(size))
        cut = (size - 9) // 9  # both lose as many of their shingles as 0.8 allows
        left.append(text[cut:])
        right.append(text[: size - cut])
    wanted = lines.similar(left, right, rules)
    met = (lines.bucket_numbers(left, rules) == lines.bucket_numbers(right, rules)).any(axis=1)
    assert wanted.sum() > 1000 and met[wanted].mean() > 0.99


def _pair_of_late_sketches(rng):
    """Two texts of aligned similarity 0.8 that agree on one or two sketches after the twelfth
    only, and the numbers and values of these."""
    omh, words = neardup.Omh(), neardup.WordHashes()
    while True:
        tokens = [f"w{x}" for x in rng.integers(10**9, size=9)]
        long, short = " ".join(tokens), " ".join(tokens[:8])
        a, b = (neardup.order_sketches(neardup.labelled_kmers(t, omh.k, words), omh) for t in (long, short))
        agree = np.flatnonzero(a == b)
        if 0 < len(agree) <= 2 and agree[0] >= 12:
            return long, short, {int(place): a[place] for place in agree}


def _late_rows():
    """Rows of which only 0 and 1 are near; their only common buckets are large ones of late
    sketches."""
    rng = np.random.default_rng(15)  # its pair is dealt into different cells
    omh, words = neardup.Omh(), neardup.WordHashes()
    long, short, agree = _pair_of_late_sketches(rng)
    others = []
    for place, value in agree.items():
        found = 0
        while found < 80:  # texts of another kind that fall into the same bucket
            text = f"{long} " + " ".join(f"w{x}" for x in rng.integers(10**9, size=2))
            if neardup.order_sketches(neardup.labelled_kmers(text, omh.k, words), omh)[place] == value:
                others.append(text)
                found += 1
    return list(enumerate([long, short, *others]))


def test_large_buckets_of_late_sketches_are_searched(spark):
    rows = _late_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: 0 if i == 1 else i for i in range(len(rows))}


def test_pipeline_stage_searches_large_buckets(spark):
    """The pipeline's stage keeps one document of such a pair, and all others."""
    rows = _late_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == {i for i, _ in rows} - {1}


def test_block_groups_meet_all_that_may_join(spark):
    """Every two rows of a bucket that lie in different components meet in a group."""
    rows = [(b, r, 0 if r < 70 else r // 3, 40) for b in (1, 2) for r in range(100)]
    members = spark.createDataFrame(rows, "bucket long, row long, root long, n long").withColumn("size", F.lit(100))
    groups = collections.defaultdict(set)
    for r in rounds.block_groups(rounds.open_members(members, 4), 16, 1000).collect():
        groups[r.group].add(r.row)
    assert max(map(len, groups.values())) < 70
    root = {r: 0 if r < 70 else r // 3 for r in range(100)}
    for a in range(100):
        for b in range(a):
            assert root[a] == root[b] or sum({a, b} <= g for g in groups.values()) >= 2


def test_white_space_is_sought_by_text_not_by_line(spark, capsys):
    """Lines of texts with and without odd white space come out alike, with no regular
    expression tried on every line."""
    texts = [
        "one two\nthree", " one two \n\n three", "one\ttwo\r\nthree\x0b", "  \n\t\r\nx  y\x0c\x0cz \n  a", " ", "", None,
        "a\r\nb", "a b\nc d",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lines._lines(df, "doc_id", "text")
    expected = []
    for i, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            line = re.sub("[ \t\x0b\x0c\r]+", " ", line).strip(" ")
            if line:
                expected.append((i, n, line, hashlib.md5(line.encode()).digest()))
    assert sorted((r.id, r.line_no, r.line, bytes(r.key)) for r in got.collect()) == expected
    got.explain()
    assert "RLIKE" not in capsys.readouterr().out


def test_lines_are_split_once(spark, monkeypatch, capsys):
    """Sketches and texts come from the stored lines; no later step splits texts again."""
    text = "a line that several texts share, but for a number at its end: "
    rows = [(i, f"{text}{i}\n{i * 7919:020d}\n") for i in range(12)]
    plans, store = {}, lines.store

    def seen(df, name):
        capsys.readouterr()
        df.explain()
        plans.setdefault(name, capsys.readouterr().out)
        return store(df, name)

    monkeypatch.setattr(lines, "store", seen)
    classes = lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in classes.collect() if r.line_no == 0} == dict.fromkeys(range(12), 0)
    assert [name for name, plan in plans.items() if "split(" in plan] == ["lines"]


def test_shared_buckets_are_those_of_several_rows(spark):
    """Equal numbers in different bands are different buckets."""
    rows = [(1, [5, 6]), (2, [5, 7]), (3, [7, 8]), (4, [5, 8])]
    got = lines._shared_buckets(spark.createDataFrame(rows, "row long, buckets array<long>"))
    assert sorted((r.bucket, r.band, r.row, r.size) for r in got.collect()) == [
        (5, 0, 1, 3), (5, 0, 2, 3), (5, 0, 4, 3), (8, 1, 3, 2), (8, 1, 4, 2),
    ]
