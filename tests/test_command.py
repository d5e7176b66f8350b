"""The command's channels, dry run, writers and encodings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from larkspur.plans import brief
from larkspur.settings import Settings
from larkspur.sources import feeds, writers
from larkspur.streaming import channels


def test_stdout_parts_messages(capsys):
    assert channels.Stdout().send("one\n\ntwo") and channels.Stdout().send("three")
    assert capsys.readouterr().out == "one\n\ntwo\n---\nthree\n---\n"


def test_dry_run_numbers_messages(spark, capsys):
    brief.show(spark.createDataFrame([(2, "bcd"), (0, "a")], "message_pos int, text string"))
    assert capsys.readouterr().out == "\n--- message 1 of 2 (1 chars) ---\na\n\n--- message 2 of 2 (3 chars) ---\nbcd\n\n"


def test_models_are_asked_over_http():
    sent = []

    def opener(request, timeout):
        sent.append((request.full_url, json.loads(request.data), dict(request.header_items())))
        return json.dumps({"response": " local \n", "choices": [{"message": {"content": " hosted "}}]}).encode()

    assert writers.local_model("http://host:1/", "small", opener)("ask") == "local"
    assert writers.hosted_model("secret", "large", "https://models.example/v1", opener)("ask") == "hosted"
    assert [s[0] for s in sent] == ["http://host:1/api/generate", "https://models.example/v1/chat/completions"]
    assert sent[0][1]["prompt"] == "ask" and sent[1][1]["messages"][1]["content"] == "ask" and sent[1][2]["Authorization"] == "Bearer secret"


@pytest.mark.parametrize("name, given, n", [("auto", {}, 0), ("none", {"hosted_key": "k", "hosted_model": "m"}, 0), ("auto", {"hosted_key": "k", "hosted_model": "m"}, 3), ("auto", {"local_url": "http://x", "local_model": "m"}, 3), ("titles", {}, 1)])
def test_writers_of_a_run(name, given, n):
    assert len(brief.chosen_writers(name, Settings(**given))) == n


def test_encodings_of_feeds(spark):
    text = '<?xml version="1.0" encoding="{}"?><rss>José</rss>'
    raws = [text.format("ISO-8859-1").encode("latin-1"), text.format("utf-8").encode(), text.format("UTF-16").encode("utf-16"), b"\xef\xbb\xbf" + text.format("utf-8").encode(), "<rss>José</rss>".encode()]
    got = [r.x for r in spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raws)], "i int, b binary").orderBy("i").select(feeds.decoded(F.col("b")).alias("x")).collect()]
    assert all(x.endswith("<rss>José</rss>") for x in got) and not got[3].startswith("﻿")
