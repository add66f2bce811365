"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agentlog.llm import (
    exact, html, lines, mining, mixing, neardup, packing, quality, secrets, sharding, tokenfile, trie, urls,
)
from agentlog.llm.common import store, text_or_empty, word_count
from agentlog.session import shared_folder

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op5_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
      FROM documents
    )
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
           sha256(norm) AS text_sha256
    FROM t WINDOW g AS (PARTITION BY norm)
    """,
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_dedup(docs).select(
        "doc_id", "keep_id", F.col("group_size").cast("long"), "kept", "text_sha256"
    )


@query("op1_two_pass_shuffle")
def op1_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = sharding.row_bytes(F.col("text"))
    return sharding.two_pass_shuffle(docs, size, n_shards=24, seed=1).select(
        "doc_id", size.alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op3_mix_sources",
    r"""
    WITH d AS (
      SELECT doc_id, source,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             ('0x' || substr(md5('3|' || coalesce('=' || doc_id, '-') || '|'
               || coalesce('=' || text, '-')), 1, 15))::BIGINT AS key
      FROM documents
    ), s AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS r
      FROM d GROUP BY source
    ), l AS (
      SELECT *, 3 * source_size AS cap,
             (sum(source_size) OVER () - (sum(3 * source_size) OVER o - 3 * source_size))::DOUBLE
               / (sum(w) OVER () - (sum(w) OVER o - w)) AS rest
      FROM s WINDOW o AS (ORDER BY 3 * source_size / w, r)
    ), t AS (
      SELECT source, source_size,
             least(cap::DOUBLE, w * (SELECT min_by(rest, (cap / w, r)) FROM l WHERE cap / w >= rest)) AS target
      FROM l
    ), p AS (
      SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 1e-6)::BIGINT AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target,
           (CASE WHEN source_size = 0 THEN 0 ELSE
              budget // source_size * size
              + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken
    FROM p
    """,
)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = store(
        docs.select(
            "doc_id", "source", word_count(text_or_empty("text")).alias("size"),
            mixing.hash_key(3, F.col("doc_id"), F.col("text")).alias("key"),
        ),
        "sizes",
    )
    return mixing.mix(sized, "source", "size", "key").select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query(
    "op4_clean_lines",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
    ), l AS (
      SELECT rid, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
    ), judged AS (
      SELECT *, n > 0 AND (
          (n >= 3 AND length(regexp_replace(line, '[^|]', '', 'g')) >= n * 0.2)
          OR length(regexp_replace(line, '[^#*$%&]', '', 'g')) >= n * 0.5
          OR (n >= 4 AND regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '\p{Ll}'))
          OR regexp_matches(line, '(?i)all rights reserved|licen[sc]ed under|released under|public license|copyright \(c\)|cookie policy|privacy policy|terms of (use|service)|powered by|click here|sign up|log in to')
          OR NOT regexp_matches(line, '[.!?…:;"\x27»”)\]][\x20\x09-\x0D]*$|[.!?…][\x20\x09]')
        ) AS fails
      FROM l
    ), lines AS (
      SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
             coalesce(sum(n) FILTER (fails), 0) AS lost
      FROM judged GROUP BY rid
    ), w AS (
      SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
             generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos
      FROM d
    ), g AS (
      SELECT rid, pos, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN
        word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' '
        || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS gram
      FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)
    ), rep AS (
      SELECT rid, pos, gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1 AS twice FROM g
    ), cov AS (
      SELECT rid, count(*) FILTER (hit) AS n_repeat_words
      FROM (SELECT rid, bool_or(twice) OVER (PARTITION BY rid ORDER BY pos ROWS 4 PRECEDING) AS hit FROM rep)
      GROUP BY rid
    ), base AS (
      SELECT d.rid, doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost
      FROM d JOIN lines USING (rid) LEFT JOIN cov USING (rid)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND lost <= 0.5 * n_words AS kept
    FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
    """,
)
def op4_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != "guess")
    return secrets.scan(docs, WORD_VOCABULARY).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"),
    )


URL_RULES = (
    urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"),
    urls.Rule("www.example.com", "/en/", "allow"), urls.Rule("net", "/es/", "block"),
    urls.Rule("net", "/fr/", "block"),
)


def _strength_sql(groups: str) -> str:
    return f"""(
      SELECT CASE WHEN coalesce(n, 0) = 0 OR noise = 0 OR n - n2 / n - (k - 1) <= 0 THEN 1000.0
             ELSE (1 - rho) / rho END
      FROM (SELECT *, least(greatest((spread - noise / n * (k - 1))
                      / (noise / n * (n - n2 / n - (k - 1))), 1.0 / 1001), 0.5) AS rho
            FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n) AS n2,
                         sum(n * (bad::DOUBLE / n - prior) * (bad::DOUBLE / n - prior)) AS spread,
                         sum(n * prior * (1 - prior)) AS noise
                  FROM {groups} WHERE n > 0)))"""


@query(
    "op7_url_reputation",
    rf"""
    WITH u AS (
      SELECT page_id,
             translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
      FROM pages
    ), r(rule, rhost, rpath, rv) AS (
      VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
             ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
             ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
    ), o AS (
      SELECT host, greatest(1 - quality, toxic) AS bad
      FROM u JOIN labels ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})/?$', 1) AS BIGINT)
      UNION ALL SELECT host, NULL FROM u
    ), h0 AS (
      SELECT host, CASE WHEN d = '' THEN host ELSE d END AS domain, n, bad FROM (
        SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
               regexp_extract(host, '([^.]+\.(?:co\.uk|org\.uk|ac\.uk|com\.au|co\.jp|co\.nz|com\.br|[^.]+))$', 1) AS d
        FROM o GROUP BY host)
    ), d0 AS (
      SELECT domain, regexp_replace(domain, '^[^.]*\.', '') AS suffix, sum(n) AS n, sum(bad) AS bad
      FROM h0 GROUP BY ALL
    ), s0 AS (
      SELECT suffix, sum(n) AS n, sum(bad) AS bad,
             coalesce((SELECT sum(bad)::DOUBLE / nullif(sum(n), 0) FROM d0), 0) AS prior
      FROM d0 GROUP BY suffix
    ), s1 AS (SELECT suffix, (bad + prior * k) / (n + k) AS m FROM s0, (SELECT {_strength_sql("s0")} AS k)
    ), d1 AS (SELECT d0.*, m AS prior FROM d0 JOIN s1 USING (suffix)
    ), d2 AS (SELECT domain, (bad + prior * k) / (n + k) AS m FROM d1, (SELECT {_strength_sql("d1")} AS k)
    ), h1 AS (SELECT h0.*, m AS prior FROM h0 JOIN d2 USING (domain)
    ), h2 AS (
      SELECT host, p - 1.645 * sqrt(p * (1 - p) / (t + 1)) AS low
      FROM (SELECT host, (bad + prior * k) / (n + k) AS p, n + k AS t FROM h1, (SELECT {_strength_sql("h1")} AS k))
    ), best AS (
      SELECT page_id, host, path, rule, rv,
             row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) AS no
      FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    )
    SELECT page_id, host, path, rule,
           coalesce(rv, CASE WHEN low > 0.3 THEN 'block' ELSE 'allow' END) AS verdict
    FROM best JOIN h2 USING (host) WHERE no = 1
    """,
)
def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = urls.labelled_outcomes(pages, table(spark, sf_dir, "labels"))
    return urls.filter_urls(pages, outcomes, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@query("op2_pack_sequences")
def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.token_pieces(docs, WORD_VOCABULARY))


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op9_wrapper_text")
def op9_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


@query("op6_fuzzy_lines")
def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(table(spark, sf_dir, "documents"))


#: CRC-32 of a decimal number's digits, a bit at a time.
_CRC_SQL = """xor(list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda x, y: list_reduce(
    [xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT)"""


@query(
    "op11_prefix_trie",
    rf"""
    WITH t AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS key, turn
      FROM conversations WHERE conv_id IS NOT NULL
    ), o AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos,
             strlen(text) AS bytes
      FROM t
    ), n AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS donor FROM o GROUP BY conv_id
    ), h AS (
      SELECT a.conv_id, a.donor, a.own, {_CRC_SQL.format("a.conv_id")} % 9 AS h, coalesce(b.own, 0) AS n_donor
      FROM n a LEFT JOIN n b ON a.donor = b.conv_id
    ), r AS (
      SELECT h.conv_id AS c, o.pos, key, bytes FROM h JOIN o ON o.conv_id = h.donor AND o.pos < h
      UNION ALL
      SELECT h.conv_id, o.pos - h + least(h, n_donor), key, bytes FROM h JOIN o ON o.conv_id = h.conv_id AND o.pos >= h
    ), m AS (
      SELECT c, pos + 1 AS depth, bytes, string_agg(key, '') OVER (PARTITION BY c ORDER BY pos) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM h
    ), total AS (SELECT conv_id AS c, least(h, n_donor) + greatest(own - h, 0) AS n FROM h
    ), node AS (
      SELECT path, depth, any_value(bytes) AS bytes, min(m.c) AS conv_id, count(*) AS n_convs,
             string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (total.n = depth) AS ends
      FROM m JOIN total USING (c) GROUP BY path, depth
    ), child AS (
      SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
    ), below AS (
      SELECT m.path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * u.bytes)::BIGINT AS saved
      FROM node u LEFT JOIN child USING (path) JOIN m ON m.c = u.conv_id AND m.depth <= u.depth
      GROUP BY m.path
    )
    SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children,
           n_leaves, saved AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
    FROM node v LEFT JOIN child USING (path) JOIN below ON v.path = below.path
    LEFT JOIN node p ON v.depth > 0 AND p.path = left(v.path, length(v.path) - 32)
    """,
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query(
    "op12_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
    ), s AS (
      SELECT a.vec_id AS anchor, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ), p AS (
      SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor AS anchor_id, p.vec_id AS positive_id,
           row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id,
           p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
      AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    WINDOW w AS (PARTITION BY p.anchor, p.vec_id ORDER BY s.score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= 10
    """,
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


@query("op13_token_files")
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/llm-token-files-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenfile.write_tokens(docs, path, WORD_VOCABULARY, end_id=1)
    return tokenfile.read_tokens(spark, path)
