"""Broken JSON objects, and zip archives of exports."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from convmatch.functions.repair import _of, repair_json
from convmatch.sources import archives

BROKEN = [
    ('{"a": 1, "b": [1, 2', {"a": 1, "b": [1, 2]}),
    ('{"a": "cut off he', {"a": "cut off he"}),
    ('{"a": "x", "b"', {"a": "x"}),
    ('{"a": "x", "b":', {"a": "x"}),
    ('{"a": "x", "b": tr', {"a": "x", "b": True}),
    ("{'a': 'it', 'b': None, 'c': True}", {"a": "it", "b": None, "c": True}),
    ("{'a': 'it's here', 'b': 2}", {"a": "it's here", "b": 2}),
    ('{"a": "say "yes" now", "b": 2}', {"a": 'say "yes" now', "b": 2}),
    ('{a: 1, b: "x",}', {"a": 1, "b": "x"}),
    ('{"a": [1, 2,], "b": {"c": 3,},}', {"a": [1, 2], "b": {"c": 3}}),
    ('{"a": 1 // note\n, /* more */ "b": 2}', {"a": 1, "b": 2}),
    ('{"a": "x" "b": "y"}', {"a": "x", "b": "y"}),
    ('{"a": "two\nlines"}', {"a": "two\nlines"}),
    ('{"a": [1, 2}', {"a": [1, 2]}),
    ('Here:\n```json\n{"a": "x",\n "b": 1\n```\nDone.', {"a": "x", "b": 1}),
    ('{"a": +5, "b": .5, "c": 007}', {"a": 5, "b": 0.5, "c": 7}),
    ('{“a”: “x”}', {"a": "x"}),
    ('{"a": plain words, "b": 1}', {"a": "plain words", "b": 1}),
    ('{"a": [1, 2}, "b": 3}', {"a": [1, 2], "b": 3}),
    ("{}", {}),
    ('{"a": {"b": [true, null, "\\u00e9\\n"]}} and {"other": 1}', {"a": {"b": [True, None, "é\n"]}}),
]


@pytest.mark.parametrize("text,want", BROKEN)
def test_repaired(text, want):
    got, reason = _of(text)
    assert reason is None and json.loads(got) == want


@pytest.mark.parametrize("text,reason", [(None, "null"), ("", "no object"), ("I cannot", "no object"), ("[1, 2]", "no object"), ("{", "no field"), ("{{1}}", "a bracket where a key belongs")])
def test_rejected_with_a_reason(text, reason):
    assert _of(text) == (None, reason)


def test_every_truncation_of_an_object_keeps_the_fields_before_it():
    whole = {"title": "a, {b} [c]: 'd'", "ids": [1, 22, 333], "deep": {"x": [{"y": "z"}], "n": -1.5}, "ok": True}
    text = json.dumps(whole)
    for cut in range(12, len(text) + 1):
        got, reason = _of(text[:cut])
        assert reason is None
        fields = json.loads(got)
        assert list(fields) == list(whole)[: len(fields)]
        for k in list(fields)[:-1]:
            assert fields[k] == whole[k]


def test_repair_in_spark_and_of_long_texts(spark):
    rows = [(i, t) for i, (t, _) in enumerate(BROKEN)] + [(99, None), (100, '{"a": "' + "long, text: " * 60_000), (101, "{\"a\":" * 5000)]
    got = {r["i"]: r["r"] for r in spark.createDataFrame(rows, "i int, t string").select("i", repair_json("t").alias("r")).collect()}
    assert [json.loads(got[i]["json"]) for i in range(len(BROKEN))] == [w for _, w in BROKEN]
    assert got[99]["reason"] == "null" and len(got[100]["json"]) > 700_000 and got[101]["reason"] == "nested too deeply"


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 20])
def test_array_items_of_any_piece_size(chunk):
    items = [{"a": "x]},[{"}, 12, "s, t", [1, [2]], None, {}, {"long": "y" * 50}]
    got = list(archives.array_items(io.StringIO("﻿ " + json.dumps(items, indent=1)), chunk))
    assert [json.loads(x) for x in got] == items
    assert list(archives.array_items(io.StringIO("[ ]"), chunk)) == []
    for bad in ('{"a": 1}', "", '[{"a": 1}, {"b"'):
        with pytest.raises(ValueError):
            list(archives.array_items(io.StringIO(bad), chunk))


def test_archives_written_and_read_and_broken_ones(spark, tmp_path):
    path = str(tmp_path / "zips")
    rows = [(u, "openai", i, json.dumps({"uuid": f"{u}-{i}", "name": "é", "chat_messages": []})) for u in range(3) for i in range(40 if u else 200)]
    df = spark.createDataFrame(rows, "user int, provider string, i int, item string")
    assert archives.write_archives(df, path, ["i"], 4) == 4
    with zipfile.ZipFile(f"{path}/bad.zip", "w") as z:
        z.writestr("7/openai/conversations.json", '[{"uuid": "whole", "chat_messages": []}, 5, {"uuid"')
        z.writestr("8/openai/conversations.json", "no array")
        z.writestr("8/openai/picture.png", "x")
    (tmp_path / "zips" / "worse.zip").write_bytes(b"no archive")
    good, bad = archives.read_archives(spark, path)
    got = sorted((r["user_id"], r["uuid"], r["shape"]) for r in good.collect())
    assert got == sorted([(str(u), f"{u}-{i}", "list") for u, _, i, _ in rows] + [("7", "whole", "list")])
    reasons = sorted((r["archive"].rsplit("/", 1)[1], r["member"] or "", -1 if r["position"] is None else r["position"]) for r in bad.collect())
    assert reasons == [("bad.zip", "7/openai/conversations.json", 1), ("bad.zip", "7/openai/conversations.json", 2), ("bad.zip", "8/openai/conversations.json", 0), ("worse.zip", "", -1)]
    empty = tmp_path / "none"
    empty.mkdir()
    assert archives.read_archives(spark, str(empty))[0].count() == 0
