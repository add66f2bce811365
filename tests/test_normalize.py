"""Readers, normalisation and text functions."""

import json
import math
import uuid
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from agentlog.config import LongTextConfig, NormalizeConfig
from agentlog.functions import records as rules, text as tx
from agentlog.functions.ids import canonical_request_id, uuid5
from agentlog.functions.numeric import parse_long, round_to
from agentlog.functions.taxonomy import normalize_label
from agentlog.operators import classify, normalize as nz
from agentlog.sources.raw import read_raw, with_row_index


def value(spark, column, *args, kind="string"):
    schema = ", ".join(f"c{i} {kind}" for i in range(len(args)))
    return spark.createDataFrame([tuple(args)], schema).select(column(*[F.col(f"c{i}") for i in range(len(args))])).first()[0]


def raw(spark, tmp_path, data, fmt="json"):
    path = tmp_path / f"in.{fmt}"
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return with_row_index(read_raw(spark, str(path), fmt))


def test_reject_reasons(spark, tmp_path):
    rows = raw(spark, tmp_path, [{"user_query": "ok"}, {"user_query": "  "}, {"x": 1}, "not an object"])
    report = nz.normalize(rows).report.first()
    assert (report.records_total, report.records_valid, report.records_rejected) == (4, 1, 3)
    assert report.rejected_reasons == {"empty_query_text": 2, "not_an_object": 1}


@pytest.mark.parametrize("key", ["records", "logs", "data", "items", "queries"])
def test_wrappers(spark, tmp_path, key):
    rows = raw(spark, tmp_path, {"meta": 1, key: [{"user_query": "a"}, {"user_query": "b"}]})
    assert [r.user_query for r in rows.orderBy("row_idx").collect()] == ["a", "b"]


def test_first_wrapper_with_a_list_wins(spark, tmp_path):
    rows = raw(spark, tmp_path, {"records": {"x": 1}, "data": [{"user_query": "d"}], "logs": [{"user_query": "l"}]})
    assert [r.user_query for r in rows.collect()] == ["l"]


def test_jsonl_skips_blank_lines_and_bom(spark, tmp_path):
    rows = raw(spark, tmp_path, '﻿{"user_query": "a"}\n\n  \n{"user_query": "b"}\n7\n{broken\n', "jsonl")
    got = [(r.user_query, r.is_object) for r in rows.orderBy("row_idx").collect()]
    assert got == [("a", True), ("b", True), (None, False), (None, False)]


def test_csv_tools_and_numbers(spark, tmp_path):
    data = 'user_query,tools_used,simulated_context_tokens,manual_time\n"a, b","CRM,Mail",5000,bad\nc,"[""X""]",oops,12\n'
    out = nz.normalize(raw(spark, tmp_path, data, "csv")).records.orderBy("query_text").collect()
    assert [(r.query_text, r.tools_used, r.tokens, r.manual_time_minutes) for r in out] == [
        ("a, b", ["CRM", "Mail"], 5000, None),
        ("c", ["X"], None, 12.0),
    ]


def test_full_record(spark, tmp_path):
    rec = {
        "request_id": "r1", "user_query": " hi ", "status": "ERROR_TOOL", "total_tokens": 12.7, "model": "gpt",
        "timestamp": "2026-07-25T10:00:00Z", "style": "typò", "metadata": {"user_email": "a@b.c", "tools_used": ["T"]},
    }
    out = nz.normalize(raw(spark, tmp_path, [rec]), NormalizeConfig(namespace="src"))
    row, log = out.records.first(), out.logs.first()
    assert row.request_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "agentlog:src:r1"))
    assert (row.query_text, row.status, row.tokens, row.style, row.user_id) == ("hi", "ERROR_TOOL", 12, "typo", "a@b.c")
    assert row.tools_used == ["T", "model:gpt"] and row.timestamp == datetime(2026, 7, 25, 10)
    assert (log.response_status, log.error_code, log.metadata.external_request_id) == ("error", "tool_error", "r1")


def test_synthetic_times_span_the_period(spark, tmp_path):
    rows = raw(spark, tmp_path, [{"user_query": str(i)} for i in range(4)])
    got = [r.timestamp for r in nz.normalize(rows).records.orderBy("query_text").collect()]
    assert got[0] == datetime(2024, 1, 18) and got[2] == datetime(2024, 1, 25)
    fixed = nz.normalize(rows, NormalizeConfig(synthesize=False))
    assert {r.timestamp for r in fixed.records.collect()} == {datetime(2024, 2, 1)}
    assert fixed.report.first().synthesized_timestamp == 0


def test_row_index_is_dense_over_many_files(spark, tmp_path):
    spark.range(1000).repartition(7).select(F.to_json(F.struct(F.col("id").cast("string").alias("user_query"))).alias("value")).write.text(str(tmp_path / "d"))
    rows = with_row_index(read_raw(spark, str(tmp_path / "d"), "jsonl"))
    assert sorted(r.row_idx for r in rows.select("row_idx").collect()) == list(range(1000))


@pytest.mark.parametrize(
    "given_style, want",
    [("typoy", "typo"), ("typò", "typo"), ("voice_jargon", "voice"), ("corporate slang", "jargon"), ("formnal", "formal"),
     ("Formal", "formal"), ("error_tool", None), ("hallucination_loop", None), ("", None), ("poetic", "poetic")],
)
def test_style(spark, given_style, want):
    assert value(spark, rules.normalize_style, given_style) == want


@pytest.mark.parametrize(
    "text, want",
    [("2026-07-25", "2026-07-25 00:00:00"), ("2026-07-25T10:00:00Z", "2026-07-25 10:00:00"), ("2026-07-25 10:00", "2026-07-25 10:00:00"),
     ("2026-07-25T10", "2026-07-25 10:00:00"), ("2026-07-25T10:00:00.5+03:00", "2026-07-25 07:00:00.5"),
     ("12:00", None), ("2026-02-30", None), ("soon", None), ("2026-07-25x", None)],
)
def test_timestamps(spark, text, want):
    assert value(spark, lambda c: rules.parse_timestamp(c).cast("string"), text) == want


@pytest.mark.parametrize("text, want", [("1e3", 1000), ("12.9", 12), ("-3.9", -3), (" 7 ", 7), ("nan", None), ("1d", None), ("inf", None), ("", None), ("x", None)])
def test_whole_numbers(spark, text, want):
    assert value(spark, parse_long, text) == want


def test_manual_alias_rule(spark):
    f = rules.manual_minutes_of
    assert value(spark, f, "0", "", "5") == 5.0
    assert value(spark, f, "bad", "5", None) is None
    assert value(spark, f, None, None, "0.0") is None


def test_rounding(spark):
    for x, want in [(12.25, 12.3), (-12.25, -12.3), (0.0, 0.0), (2.5, 2.5)]:
        assert value(spark, lambda c: round_to(c, 1), x, kind="double") == want


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=40))
def test_uuid5_property(spark, name):
    assert value(spark, uuid5, name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_ids_without_namespace_pass(spark):
    assert value(spark, lambda c: canonical_request_id(c, None), "abc") == "abc"


@pytest.mark.parametrize(
    "reply, want",
    [("code_help", "code_help"), (" `Data Analysis` ", "data_analysis"), ("task-management", "task_management"),
     ("Анализ данных", "data_analysis"), ("education\nbecause", "education"), ("nothing", None), ("", None), ("unknown", None)],
)
def test_labels_of_free_text(spark, reply, want):
    assert value(spark, normalize_label, reply) == want


@pytest.mark.parametrize(
    "reply, kind, score",
    [('{"task_type": "code_help", "confidence": 0.9}', "code_help", 0.9), ('```json\n{"task_type": "education"}\n```', "education", 0.55),
     ("it is task_management I think", "task_management", 0.55), ("???", "other", 0.4), ('{"task_type": "zzz", "confidence": 0.9}', "other", 0.4),
     ('{"task_type": "other", "confidence": 7}', "other", 1.0)],
)
def test_replies(spark, reply, kind, score):
    assert tuple(value(spark, classify.parse_reply, reply)) == (kind, score)


def test_json_in_replies(spark):
    f = tx.extract_json
    assert value(spark, f, '<think>{"no": 1}</think> text ```json\n{"a": 1}\n``` tail') == '{"a": 1}'
    assert value(spark, f, 'answer: {"a": {"b": 2}} done') == '{"a": {"b": 2}}'
    assert value(spark, f, "[1, 2]") == "[1, 2]"
    assert value(spark, f, "{broken") is None and value(spark, f, "none") is None


def test_message_text(spark):
    f = tx.message_text
    assert value(spark, f, "plain") == "plain"
    assert value(spark, f, '[{"type":"text","text":"a"},{"type":"image"},"b"]') == "a b"


def test_status_of_stored_rows_is_case_sensitive(spark):
    assert value(spark, lambda c: rules.exact_status_pair(c)["error_code"], "Error_Tool") is None
    assert value(spark, lambda c: rules.status_pair(c)["error_code"], "Error_Tool") == "tool_error"


WORD = st.text(alphabet="abc é\x1c\u00a0\u2003\n", min_size=0, max_size=30)


@settings(max_examples=25, deadline=None)
@given(WORD, st.integers(1, 6), st.integers(0, 7))
def test_chunks_property(spark, text, size, overlap):
    """Windows advance by size - overlap and end with the first one that reaches the end."""
    w = text.split()
    step = size - max(0, min(overlap, size - 1))
    count = 0 if not w else 1 + max(0, math.ceil((len(w) - size) / step))
    want = [" ".join(w[i * step : i * step + size]) for i in range(count)]
    assert value(spark, lambda c: tx.word_chunks(c, size, overlap), text) == want


def test_chunk_sizes(spark):
    text = " ".join(f"w{i}" for i in range(100))
    chunks = value(spark, lambda c: tx.word_chunks(c, 20, 5), text)
    assert len(chunks[0].split()) == 20 and len(chunks) > 1 and chunks[-1].endswith("w99")


def test_long_text(spark):
    cfg = LongTextConfig(max_direct=50, chunk=20, overlap=5, max_chunks=3, head_words=4)
    text = " ".join(f"w{i}" for i in range(100))
    out = value(spark, lambda c: tx.long_text(c, cfg), text)
    assert out.strategy == "chunk_summary" and out.original_tokens == 100 and out.chunks_processed == 7
    assert out.representation == "w0 w1 w2 w3 [...] w15 w16 w17 w18 [...] w90 w91 w92 w93"
    short = value(spark, lambda c: tx.long_text(c, cfg), "  a  b ")
    assert tuple(short) == ("a  b", "direct", 0, 2)


def test_intake(spark):
    schema = "request_id string, source_id string, query_text string, timestamp string, arrival int"
    rows = [("r1", "s", "good", "2026-01-01", 1), ("r2", "s", " ", "2026-01-01", 2), ("r3", "s", "x", "bad", 3), ("r4", "s", "good", "2026-01-01", 4)]
    none = spark.createDataFrame([], "request_id string")
    batch = spark.createDataFrame(rows, schema)
    accepted, counts = nz.intake(batch, none)
    assert sorted(r.request_id for r in accepted.collect()) == ["r1", "r4"]
    assert tuple(counts.first()) == ("s", 2, 2, 0)
    again = nz.intake(batch.limit(1), accepted.select("request_id"))[1].first()
    assert (again.accepted, again.duplicates) == (0, 1)
