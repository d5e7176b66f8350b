from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import grounding, links, render, summarize
from larkspur.plans import brief
from larkspur.settings import Settings, SettingsError
from larkspur.streaming import channels, state


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t"))).first()[0]


def facts(spark, summary, sources):
    claims = spark.createDataFrame([(1, summary)], "k long, summary string")
    held = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(sources)], "k long, pos long, title string, summary string")
    return claims, held


def grounded(spark, summary, *sources):
    claims, held = facts(spark, summary, [s if isinstance(s, tuple) else (s, "") for s in sources])
    return {r.name: r.grounded for r in grounding.ungrounded_names(claims, held, "k").collect()}


def test_grounding_cascade(spark):
    assert grounded(spark, "He met Devin Booker today.", "Nothing about him") == {"Devin Booker": False}
    assert grounded(spark, "He met Jayson Brown today.", "Jaylen Brown and Jayson Tatum talk", "they said Jayson Tatum left") == {"Jayson Brown": False}
    assert grounded(spark, "The New York Knicks won.", "Knicks win again") == {"New York Knicks": True}
    assert grounded(spark, "The Eastern Conference is close.", "no word") == {"Eastern Conference": True}
    assert grounded(spark, "The Philadelphia Sixers won.", "the 76ers win") == {"Philadelphia Sixers": True}
    assert grounded(spark, "At Madison Square Garden they played.", "at MSG tonight") == {"Madison Square Garden": True}
    assert grounded(spark, "It is Mike D'Antoni and Kawhi Leonard's night.", "Coach Mike D’Antoni", "Kawhi Leonard plays") == {"Mike D'Antoni": True, "Kawhi Leonard's": True}
    assert grounded(spark, "Ayo Dosunmu stays.", "the playoffs") == {"Ayo Dosunmu": False}
    assert grounded(spark, "Los Angeles Lakers sign.", "Inside Lakers mega-deal", "what goes on inside") == {"Los Angeles Lakers": True}


def test_sentences_end_before_closing_quotes(spark):
    assert one(spark, X.sentences, 'So “Hollywood Ending.” Meanwhile Charles left. Next! ') == ["So “Hollywood Ending.", "Meanwhile Charles left.", "Next!", ""]


def test_validation(spark):
    claims, held = facts(spark, "Here are the facts: Leon Rose paid $3.3M and $52.2 million.", [("The Suns paid $52.2M", "")])
    row = grounding.validated(claims, held, "k").first()
    assert (row.invented_names, row.invented_figures, row.has_preamble, row.is_safe) == (["Leon Rose"], ["$3.3M"], True, False)
    assert row.description == "invented names: Leon Rose; invented figures: $3.3M; preamble present"
    assert grounding.validated(*facts(spark, "All quiet.", [("a", "")]), "k").first().description == "clean"


def test_unsupported_links(spark):
    claims, held = facts(spark, "The New Orleans Pelicans welcome Damian Lillard. Damian Lillard rests.", [("Pelicans win", ""), ("Lillard leaves Portland", "")])
    assert [r.sentence for r in grounding.unsupported_sentences(claims, held, "k").collect()] == ["The New Orleans Pelicans welcome Damian Lillard."]
    marked = render.written_news(spark.createDataFrame([(1, "One. Two. One.", ["One."])], "k long, summary string, unsupported array<string>"), ["k"], ["cbs"]).first().text
    assert marked.startswith("📰 NEWS\n\nOne. ⚠️ Two. One.\n\n⚠️ these names") and "Missing this run: cbs." in marked


@pytest.mark.parametrize("text, limit", [("a\n\nb\n\nc", 4), ("abcdefghij", 3), ("a" * 9 + "\n\nbb\n\ncc", 4), ("", 5), ("x\n\n" + "y" * 11, 5), ("\n\na\n\n\n\nb", 3)])
def test_packing(spark, text, limit):
    pieces = one(spark, lambda t: render.packed(t, limit), text)

    def plain(text):
        if len(text) <= limit:
            return [text]
        out, now = [], ""
        for block in text.split("\n\n"):
            joined = f"{now}\n\n{block}" if now else block
            if len(joined) <= limit:
                now = joined
                continue
            if now:
                out.append(now)
            while len(block) > limit:
                out.append(block[:limit])
                block = block[limit:]
            now = block
        return out + [now] * bool(now)

    assert pieces == plain(text) == channels.pieces(text, limit) and all(len(p) <= limit for p in pieces)


@pytest.mark.parametrize("text, want", [("short", "short"), ("a bb ccc dddd", "a bb…"), ("abcdefghijkl", "abcdefgh…"), (" x   y ", "x y")])
def test_truncation(spark, text, want):
    assert one(spark, lambda t: X.truncated(t, 9), text) == want


@pytest.mark.parametrize("n, want", [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"), (21, "21st"), (113, "113th"), (20, "20th")])
def test_ordinals(spark, n, want):
    assert one(spark, X.ordinal, n, "long") == want


def test_notes_and_tidying(spark):
    assert one(spark, X.note_lines, "intro\n- a\n * b\n1. c\n12) no\n• d") == ["- a", "* b", "1. c", "• d"]
    assert one(spark, X.tidy, "  a\n b\n\n \n c  d \n\n") == "a b\n\nc d"


def test_folds_are_unicode_s_own():
    for letter, plain in X.FOLDS.items():
        assert plain == "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))


def test_summaries_are_written_until_safe(spark):
    rows = spark.createDataFrame([(k, i, i, f"story {k} {i}", "") for k in (1, 2) for i in range(11 if k == 2 else 2)], "k long, pos long, place long, title string, summary string")
    calls = [lambda p: "He met Joe Dumars." if "story 1" in p else "- story 2" if "Stories" in p else "story 2 0.", lambda p: None, lambda p: "story 1 0."]
    out = {r.k: (r.summary, r.attempt) for r in summarize.safe_summaries(rows, "k", calls).collect()}
    assert out == {1: ("story 1 0.", 2), 2: ("story 2 0.", 0)}
    assert summarize.chunked_prompts(rows.where("k = 2"), ["k"]).count() == 3


def test_state_over_runs(spark, tmp_path):
    folder, at = str(tmp_path), F.current_timestamp()
    articles = spark.createDataFrame([("a",), ("b",), ("a",)], "article_id string")
    assert state.record_articles(articles, folder, at) == 2 and state.record_articles(articles, folder, at) == 0
    game = lambda score: spark.sql(f"SELECT 1L game_id, 'Final/OT' status, timestamp'2026-01-16 03:00:00' start_time, 'A' home_team, 'B' away_team, {score} home_score, 0 away_score")
    assert state.record_games(game(1), folder, at) == 1 and state.record_games(game(1), folder, at) == 0 and state.record_games(game(2), folder, at) == 1
    assert [(r.game_id, r.home_score) for r in state.results_history(spark, folder).collect()] == [(1, 2)]


def test_delivery_commits_once_something_arrived(spark):
    messages, sent, commits = spark.createDataFrame([(1, "b"), (0, "a")], "message_pos int, text string"), [], []

    def send(text, silent):
        sent.append((text, silent))
        if text == "a":
            raise OSError
        return True

    assert state.deliver(messages, send, lambda: commits.append(1)) == [False, True]
    assert sent == [("a", False), ("b", True)] and commits == [1]
    assert state.deliver(messages, lambda *_: False, lambda: commits.append(2)) == [False, False] and commits == [1]


def test_stream_gives_each_key_once(spark, tmp_path):
    for i, ids in enumerate(([1, 2, 2], [2, 3])):
        spark.createDataFrame([(x,) for x in ids], "id long").coalesce(1).write.parquet(str(tmp_path / str(i)))
    out = state.replayed(spark, str(tmp_path / "*"), "id long", lambda s: state.stream_unseen(s, "id"))
    assert sorted(r.id for r in out.collect()) == [1, 2, 3]


def test_links(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "a.md").write_text("[x](docs/b.md) [y](gone.md#p) [z](https://e.org) [w](#here) [v](docs)")
    (tmp_path / "docs" / "b.md").write_text("[up](../a.md) [bad](../c.md) ![i](./b.md 'title')")
    files = links.read_markdown(spark, str(tmp_path))
    broken = {(r.path.rsplit("/", 1)[1], r.link) for r in links.broken_markdown_links(files, files).collect()}
    assert broken == {("a.md", "gone.md#p"), ("b.md", "../c.md")}
    wiki = spark.createDataFrame([("Home.md", "[p](Page) [q](Nope) [r](https://h/o/blob/main/src/a.py) [s](https://h/o/blob/main/src/b.py)"), ("Page.md", "")], "path string, text string")
    blobs = spark.createDataFrame([("src/a.py",)], "path string")
    assert {r.link for r in links.broken_wiki_links(wiki, blobs).collect()} == {"Nope", "https://h/o/blob/main/src/b.py"}


def test_settings():
    got = Settings.from_env({"LARKSPUR_BOT_TOKEN": " t ", "LARKSPUR_CHAT_ID": " ", "LARKSPUR_POLL_INTERVAL_HOURS": "4"})
    assert (got.bot_token, got.poll_interval_hours, got.can_deliver, got.can_fetch_games) == ("t", 4, False, False)
    with pytest.raises(SettingsError):
        got.require_delivery()
    for bad in ("0", "-1", "x"):
        with pytest.raises(SettingsError):
            Settings.from_env({"LARKSPUR_DEDUP_WINDOW_HOURS": bad})


def test_brief_command(spark, tmp_path, capsys, monkeypatch):
    import json

    from .test_news import RSS

    (tmp_path / "espn").mkdir()
    (tmp_path / "games").mkdir()
    now = __import__("datetime").datetime.now(__import__("datetime").timezone.utc)
    (tmp_path / "espn" / "a.xml").write_text(RSS.replace("4 Aug 2026", now.strftime("%-d %b %Y")).replace("04 Aug 2026", now.strftime("%d %b %Y")))
    team = {"id": 1, "full_name": "Utah Jazz"}
    (tmp_path / "games" / "2026-01-15.json").write_text(json.dumps({"data": [{"id": 1, "date": "2026-01-15", "status": "Final", "home_team_score": 9, "visitor_team_score": 7, "home_team": team, "visitor_team": team}]}))
    monkeypatch.setenv("LARKSPUR_STATE_FOLDER", str(tmp_path / "state"))
    writers = [lambda p: "Nobody Atall won.", lambda p: "Jokić signs."]
    assert brief.main([str(tmp_path), "--date", "2026-01-15", "--dry-run"], writers) == 0
    assert "📰 NEWS\n\nJokić signs." in capsys.readouterr().out
    assert brief.main([str(tmp_path), "--date", "2026-01-15", "--channel", "telegram"]) == 1
    assert brief.main([str(tmp_path), "--date", "2026-01-15"]) == 0
    first = capsys.readouterr().out
    assert "Jokić signs" in first and "Utah Jazz 7 @ Utah Jazz 9  (Final)" in first and "Close finish — decided by 2" in first
    assert brief.main([str(tmp_path), "--date", "2026-01-15"]) == 0
    assert "Jokić signs" not in capsys.readouterr().out


def test_channels_answer(monkeypatch):
    posted = []

    class Answer:
        __enter__ = __exit__ = lambda *_: None

    monkeypatch.setattr(channels.urllib.request, "urlopen", lambda request, timeout: posted.append(request.data) or Answer())
    assert channels.Telegram("t", "c").send("a\n\n" + "b" * 5000) and len(posted) == 3
    monkeypatch.setattr(channels.urllib.request, "urlopen", lambda *_, **__: 1 / 0)
    assert channels.Telegram("t", "c").send("a") is False


def test_a_title_of_many_names_is_one_run(spark):
    words = ["Alpha"] * 20_000
    assert one(spark, X.title_names, " ".join(words)) == [" ".join(words)]
    assert one(spark, X.title_names, " ".join([*words, "and", *words[:2], "The Beta  Gamma"])) == [" ".join(words), "Alpha Alpha Beta Gamma"]
