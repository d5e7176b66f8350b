"""Queries over the provided tables, one for each operator, and the same in DuckDB's SQL.

Articles, games, claims and evidence are bound to the tables in sources.tables; word lists of these texts stand in for those of the default domain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import arrow, text as X, values as V
from ..operators import games as G, grounding, links, news, render, stories, summarize
from ..sources import tables as T
from ..streaming import state
from .brief import brief

COMMUNITY = ("src0", "src3")
HIGH, LOW = ("reti", "tion", "queos", "ungen"), ("edly", "heit", "leaux", "ciónes")
LIMITS = {"src0": 1, "src1": 0}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# What several SQL texts share. -------------------------------------------------------------------------------------
S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def strip(x: str, cls: str = S) -> str:
    return f"regexp_replace({x}, {q(f'^{cls}+|{cls}+$')}, '', 'g')"


def toks(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(S + '+')}), lambda t: t <> '')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(S + '+')}, ' ', 'g'), ' ')"


def visible(x: str) -> str:
    return strip(f"translate({x}, {'||'.join(f'chr({ord(c)})' for c in V.INVISIBLE)}, '')")


def tag(x: str) -> str:
    return f"regexp_extract({x}, {q(f'^{S}*' + chr(92) + '[([^' + chr(92) + ']]{1,32})' + chr(92) + ']')}, 1)"


def dep(x: str) -> str:
    return f"""regexp_replace({strip(x, '[ .,;:]')}, '[''’]s?$', '')"""


TRAIL = "[" + X.escaped(V.TRAILING).replace("'", "''") + "]"


def norm_word(x: str) -> str:
    return dep(f"lower({strip(x, '[' + X.escaped(V.TRAILING) + ']')})")


def fold(x: str) -> str:
    return f"strip_accents(translate({x}, {q(''.join(X.SHAPES))}, {q(''.join(X.SHAPES.values()))}))"


def name_words(x: str) -> str:
    return f"list_filter(list_transform({toks(fold(x))}, lambda w: {dep('lower(w)')}), lambda w: w <> '')"


def sents(x: str) -> str:
    return f"""string_split(regexp_replace({x}, '([.!?])["''”’»）)\\]]*{S}+', '\\1' || chr(1), 'g'), chr(1))"""


def scan(x: str, least: int) -> str:
    """Names of a sentence: tokens that end a run leave a mark, and runs lie between marks."""
    word = f"regexp_replace(t, '{TRAIL}+$', '')"
    shown = f"CASE WHEN regexp_matches({word}, '^\\p{{Lu}}[\\p{{L}}''’.\\-]*$') THEN {word} || CASE WHEN regexp_matches(substr(t, length({word}) + 1), '[,;:]') THEN chr(2) ELSE '' END ELSE chr(2) END"
    runs = f"list_transform(string_split(array_to_string(list_transform({toks(x)}, lambda t: {shown}), ' '), chr(2)), lambda r: trim(r, ' '))"
    return f"list_filter({runs}, lambda r: r <> '' AND len(string_split(r, ' ')) >= {least})"


def trim_name(x: str) -> str:
    parts = toks(x)
    return f"CASE WHEN len({parts}) > 1 AND list_contains({array(V.SENTENCE_STARTERS)}, lower({parts}[1])) THEN array_to_string({parts}[2:], ' ') ELSE {x} END"


def names_of(x: str, least: int) -> str:
    return f"list_transform(flatten(list_transform({sents(x)}, lambda s: {scan('s', least)})), lambda n: {trim_name(strip('n', '[ .,;:]'))})"


def subject(x: str) -> str:
    forms = "list_concat(list_concat([t], CASE WHEN contains(t, '-') THEN string_split(t, '-') ELSE CAST([] AS VARCHAR[]) END), CASE WHEN contains(t, '''') THEN [replace(t, '''', ''), split_part(t, '''', 1)] ELSE CAST([] AS VARCHAR[]) END)"
    return f"list_filter(flatten(list_transform(regexp_extract_all(lower({x}), '[a-zà-ÿ''-]+'), lambda t: {forms})), lambda t: t <> '')"


def title_names(x: str) -> str:
    runs = f"regexp_extract_all({x}, '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][a-zà-ÿ'']+(?:{S}+[A-Z][a-zà-ÿ'']+)*)', 1)"
    kept = f"list_filter({toks('r')}, lambda w: NOT list_contains({array(V.NOT_NAMES)}, lower(w)))"
    return f"list_distinct(list_filter(list_transform({runs}, lambda r: array_to_string({kept}, ' ')), lambda n: length(n) > 3))"


ARTICLES = f"article AS ({T.ARTICLES})"
GAMES = f"game AS ({T.GAMES})"
METRICS = f"""{GAMES}, lead AS (
    SELECT game_id, list((CASE WHEN home_score > away_score THEN h - a ELSE a - h END) ORDER BY i) AS steps FROM (
        SELECT game_id, home_score, away_score, unnest(home_periods) AS h, unnest(away_periods) AS a, generate_subscripts(home_periods, 1) AS i FROM game) GROUP BY game_id
), run AS (
    SELECT game_id, list_transform(generate_series(1, len(steps)), lambda i: list_sum(steps[1:i])) AS leads FROM lead
), metric AS (
    SELECT game.*, abs(home_score - away_score) AS margin, home_score + away_score AS total_points, period > 4 AS went_to_overtime,
           CAST(greatest(0, -list_min(leads)) AS INTEGER) AS largest_deficit_overcome, list_min(leads) > 0 AS led_wire_to_wire,
           greatest(list_max(home_periods), list_max(away_periods)) AS biggest_period,
           CAST(CASE WHEN len(home_periods) < 4 THEN 0 WHEN home_score > away_score THEN list_sum(home_periods[3:]) - list_sum(away_periods[3:])
                     ELSE list_sum(away_periods[3:]) - list_sum(home_periods[3:]) END AS INTEGER) AS second_half_swing
    FROM game JOIN run USING (game_id)
)"""
METRIC_COLUMNS = ["margin", "total_points", "went_to_overtime", "largest_deficit_overcome", "led_wire_to_wire", "biggest_period", "second_half_swing"]


def notable_sql() -> str:
    bars = {"comeback": f"largest_deficit_overcome >= {V.COMEBACK}", "overtime": "went_to_overtime", "wire_to_wire": f"led_wire_to_wire AND margin > {V.CLOSE} AND margin < {V.BLOWOUT}", "second_half_takeover": f"second_half_swing >= {V.SWING}"}
    most = {"closest_finish": ("margin", "ASC", f"margin <= {V.CLOSE}"), "biggest_period": ("biggest_period", "DESC", f"biggest_period >= {V.BIG_PERIOD}"), "largest_margin": ("margin", "DESC", f"margin >= {V.BLOWOUT}"), "highest_scoring": ("total_points", "DESC", f"total_points >= {V.HIGH_TOTAL}")}
    steps, last = [METRICS, "c0 AS (SELECT *, CAST(start_time AS DATE) AS day, CAST(NULL AS VARCHAR) AS category FROM metric)"], "c0"
    for i, name in enumerate(V.CATEGORIES, 1):
        if name in bars:
            takes = f"category IS NULL AND {bars[name]}"
        else:
            measure, way, bar = most[name]
            takes = f"category IS NULL AND row_number() OVER (PARTITION BY day, category IS NULL ORDER BY {measure} {way}, pos) = 1 AND {bar}"
        steps.append(f"c{i} AS (SELECT * REPLACE (CASE WHEN {takes} THEN {q(name)} ELSE category END AS category) FROM {last})")
        last = f"c{i}"
    return f"WITH {', '.join(steps)} "


PAIR = "least(home_team, away_team) || '|' || greatest(home_team, away_team)"
H2H = f"""{GAMES}, result AS (SELECT game_id AS other, CAST(start_time AS DATE) AS played_on, {PAIR} AS pair, CASE WHEN home_score > away_score THEN home_team ELSE away_team END AS winner FROM game WHERE status = 'Final'),
h2h AS (SELECT game_id, count(*) FILTER (winner = home_team) AS home_wins, count(*) FILTER (winner = away_team) AS away_wins, count(*) AS meetings
        FROM (SELECT *, {PAIR} AS pair, CAST(start_time AS DATE) AS day FROM game) g JOIN result USING (pair) WHERE played_on < day AND other <> game_id GROUP BY game_id)"""


def reason_sql() -> str:
    title, age = visible("title"), f"date_diff('microsecond', published_at, TIMESTAMP '{T.NOW}') / 3.6e9"
    phrases = " ".join(f"WHEN contains(lower({title}), {q(p)}) THEN {q('retrospective phrase ' + q(p))}" for p in V.RETROSPECTIVE_PHRASES)
    return f"""CASE WHEN {age} > {V.MAX_AGE_HOURS} THEN 'older than {V.MAX_AGE_HOURS}h (' || CAST(CAST(round_even({age}, 0) AS BIGINT) AS VARCHAR) || 'h)'
        WHEN list_contains({array(V.REJECTED_TAGS)}, lower({strip(tag(title))})) THEN 'content-type tag [' || {strip(tag(title))} || ']' {phrases}
        WHEN regexp_matches(lower({strip("coalesce(author, '')")}), '(_mod|moderator)$') THEN 'subreddit business, posted by ' || author
        WHEN list_contains({array(COMMUNITY)}, source) AND {tag(title)} = '' AND suffix({title}, '?') THEN 'community discussion, an untagged question' END"""


ORDINARY = f"ordinary AS (SELECT DISTINCT {norm_word('t')} AS word FROM (SELECT unnest(list_concat({toks('title')}, {toks('summary')})) AS t FROM article) WHERE regexp_matches(t, '^\\p{{Ll}}'))"
REASONS = f"""{ARTICLES}, {ORDINARY}, ruled AS (SELECT *, {reason_sql()} AS rule, CASE WHEN list_contains({array(COMMUNITY)}, source) AND len({toks(visible('title'))}) <= {V.MAX_OPINION_WORDS} THEN {norm_word(toks(visible('title')) + '[1]')} END AS opens FROM article),
reasoned AS (SELECT ruled.* EXCLUDE (rule, opens), coalesce(rule, CASE WHEN opens <> '' AND opens IN (SELECT word FROM ordinary) THEN 'community opinion, short and not led by a name' END) AS reason FROM ruled)"""
TIER = f"CASE WHEN list_has_any({subject('''title || ' ' || summary''')}, {array(LOW)}) THEN 'low' WHEN list_has_any({subject('''title || ' ' || summary''')}, {array(HIGH)}) THEN 'high' ELSE 'medium' END"
TIER_NO = f"CASE {TIER} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
# ---------------------------------------------------------------------------------------------------------------------


def _reasons(spark, sf):
    return news.with_reasons(T.articles(spark, sf), T.now(), community=COMMUNITY)


@query(f"WITH {REASONS}, kept AS (SELECT *, {TIER} AS tier, {TIER_NO} AS n FROM reasoned WHERE reason IS NULL AND pos % 10 <> 3) SELECT article_id, title, tier, row_number() OVER (ORDER BY n, pos) AS place FROM kept ORDER BY n, pos LIMIT 12")
def fresh_articles(spark, sf):
    """Filtered, unseen, ranked; the first twelve."""
    seen = T.articles(spark, sf).where("pos % 10 = 3").select("article_id")
    kept = news.ranked(news.unseen(_reasons(spark, sf).where("reason IS NULL"), seen), None, HIGH, LOW)
    first = kept.orderBy("rank_key").limit(V.MAX_STORIES)  # a report of twelve
    return first.select("article_id", "title", "tier", F.row_number().over(Window.orderBy("rank_key")).cast("long").alias("place"))


@query(f"WITH {METRICS} SELECT game_id, {', '.join(METRIC_COLUMNS)} FROM metric")
def game_metrics(spark, sf):
    return G.with_metrics(T.games(spark, sf)).select("game_id", *METRIC_COLUMNS)


@query(f"WITH {GAMES} SELECT game_id, sha256(concat_ws('|', game_id, status, home_score, away_score)) AS state_hash FROM game")
def game_state_hash(spark, sf):
    return T.games(spark, sf).select("game_id", G.state_hash().alias("state_hash"))


@query(f"WITH {GAMES}, h AS (SELECT game_id, sha256(concat_ws('|', game_id, status, home_score, away_score)) AS state_hash FROM game) SELECT game_id, state_hash FROM h WHERE state_hash NOT IN (SELECT state_hash FROM h WHERE game_id % 3 = 0)")
def fresh_games(spark, sf):
    games = T.games(spark, sf)
    seen = games.where("game_id % 3 = 0").select(G.state_hash().alias("state_hash"))
    return G.fresh_games(games, seen).select("game_id", "state_hash")


@query(f"WITH {H2H} SELECT game_id, home_wins, away_wins, meetings FROM h2h")
def head_to_head(spark, sf):
    games = T.games(spark, sf)
    return G.head_to_head(games, G.results_of(games))


@query(f"WITH {H2H.replace('WHERE played_on < day', 'WHERE played_on < day AND CASE WHEN month(played_on) < 10 THEN year(played_on) - 1 ELSE year(played_on) END = CASE WHEN month(day) < 10 THEN year(day) - 1 ELSE year(day) END')} SELECT game_id, home_wins, away_wins, meetings FROM h2h")
def head_to_head_of_season(spark, sf):
    games = T.games(spark, sf)
    return G.head_to_head(games, G.results_of(games), season_bounded=True)


@query(f"WITH {H2H} SELECT game_id, meetings + 1 AS meeting_number, home_wins AS home_team_prior_wins, away_wins AS away_team_prior_wins, meetings + 1 <= 1 AS is_first_meeting FROM h2h")
def series_context(spark, sf):
    games = T.games(spark, sf)
    return G.series_context(games, G.results_of(games))


@query("SELECT o_orderkey AS game_id, CAST(CASE WHEN month(o_orderdate) < 10 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS INTEGER) AS season FROM orders")
def season_of(spark, sf):
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("game_id"), X.season(F.col("o_orderdate")).alias("season"))


@query(notable_sql() + "SELECT CAST(day AS VARCHAR) AS day, category, game_id FROM c8 WHERE category IS NOT NULL")
def notable_games(spark, sf):
    games = T.games(spark, sf).withColumn("day", F.to_date("start_time"))
    return G.notable_games(games, ["day"]).select(F.col("day").cast("string").alias("day"), "category", "game_id")


@query(f"WITH {GAMES} SELECT game_id, CAST(CAST(start_time AS DATE) AS VARCHAR) AS played_on, home_team, away_team, home_score, away_score, status FROM game WHERE starts_with(lower({strip('status')}), 'final')")
def final_results(spark, sf):
    return G.results_of(T.games(spark, sf)).withColumn("played_on", F.col("played_on").cast("string"))


@query(f"WITH {ARTICLES} SELECT article_id, {collapse('lower(title)')} AS title FROM article")
def normalise_titles(spark, sf):
    return T.articles(spark, sf).select("article_id", X.normalised_title(F.col("title")).alias("title"))


@query(f"WITH {ARTICLES} SELECT article_id, sha256({collapse('lower(title)')}) AS dedup_hash FROM article")
def title_hash(spark, sf):
    return T.articles(spark, sf).select("article_id", news.dedup_hash(F.col("title")).alias("dedup_hash"))


@query(f"WITH {ARTICLES} SELECT article_id, {TIER} AS tier FROM article")
def priority_tier(spark, sf):
    return T.articles(spark, sf).select("article_id", news.tier(HIGH, LOW).alias("tier"))


TONIGHT = f"""tonight AS (SELECT DISTINCT word AS keyword FROM (SELECT unnest(regexp_extract_all(text, '[a-zà-ÿ]{{9,}}')) AS word FROM benchmark))"""


def _tonight(spark, sf):
    """Words that stand in for the names of teams."""
    words = F.explode(F.regexp_extract_all("text", F.lit("([a-zà-ÿ]{9,})"), F.lit(1)))
    return T.table(spark, sf, "benchmark").select(words.alias("keyword")).distinct()


@query(f"WITH {ARTICLES}, {TONIGHT}, w AS (SELECT DISTINCT article_id, unnest({subject('''title || ' ' || summary''')}) AS keyword FROM article) SELECT DISTINCT article_id FROM w WHERE keyword IN (SELECT keyword FROM tonight)")
def tonight_semi(spark, sf):
    return news.mentions_tonight(T.articles(spark, sf), _tonight(spark, sf))


@query("SELECT DISTINCT lower(list_last(string_split(n_name, ' '))) AS keyword FROM nation")
def team_keywords(spark, sf):
    names = T.table(spark, sf, "nation").select(F.col("n_name").alias("home_team"), F.col("n_name").alias("away_team"))
    return news.team_keywords(names)


@query(f"WITH {ARTICLES} SELECT article_id, source, {TIER} AS tier, row_number() OVER (PARTITION BY source ORDER BY {TIER_NO}, pos) AS place FROM article")
def priority_sort(spark, sf):
    ranked = news.ranked(T.articles(spark, sf), None, HIGH, LOW)
    return ranked.select("article_id", "source", "tier", F.row_number().over(Window.partitionBy("source").orderBy("rank_key")).cast("long").alias("place"))


@query(f"WITH {ARTICLES} SELECT article_id, unnest({title_names('title')}) AS name FROM article")
def name_extract(spark, sf):
    return T.articles(spark, sf).select("article_id", F.explode(X.title_names(F.col("title"))).alias("name"))


@query(f"WITH {ARTICLES} SELECT source, name, count(*) AS df FROM (SELECT source, unnest({title_names('title')}) AS name FROM article) GROUP BY ALL")
def name_doc_freq(spark, sf):
    return stories.name_counts(T.articles(spark, sf), ["source"])


RARE = f"""n AS (SELECT source, pos, unnest({title_names('title')}) AS name FROM article),
rare AS (SELECT source, pos, name FROM n JOIN (SELECT source, name, count(*) AS df FROM n GROUP BY ALL) USING (source, name)
         JOIN (SELECT source, greatest(CAST(floor(count(*) * {V.RARE_SHARE}) AS BIGINT), {V.RARE_FLOOR}) AS most FROM article GROUP BY source) USING (source) WHERE df <= most)"""


@query(f"WITH {ARTICLES}, {RARE} SELECT source, pos, name FROM rare")
def rare_names(spark, sf):
    return stories.rare_names(T.articles(spark, sf), ["source"]).select("source", "pos", "name")


@query(f"WITH {ARTICLES}, {RARE} SELECT a.source, a.pos AS early, b.pos AS late, count(*) AS shared FROM rare a JOIN rare b ON a.source = b.source AND a.name = b.name AND a.pos < b.pos GROUP BY ALL HAVING count(*) >= {V.SHARED_NAMES}")
def story_pairs(spark, sf):
    return stories.story_pairs(T.articles(spark, sf), ["source"])


@query()
def story_groups(spark, sf):
    return stories.story_groups(T.articles(spark, sf), ["source"])


@query(f"WITH {ARTICLES} SELECT source, pos FROM (SELECT source, pos, row_number() OVER (PARTITION BY pos % 7, source ORDER BY pos) AS n, CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 0 ELSE {V.SOURCE_LIMIT} END AS cap FROM article) WHERE cap = 0 OR n <= cap")
def source_cap(spark, sf):
    leads = T.articles(spark, sf).select((F.col("pos") % 7).alias("batch"), "source", F.col("pos").alias("story_pos"))
    return stories.within_source_limits(leads, ["batch"], LIMITS).select("source", F.col("story_pos").alias("pos"))


@query()
def relatedness_order(spark, sf):
    """Stories of each day-like batch, capped by source and chained."""
    rows = T.articles(spark, sf).withColumn("batch", F.floor(F.col("pos") / 100))
    return stories.build_stories(rows, ["batch"], LIMITS).select("batch", "pos", "story_pos", "member_pos", "chain_pos")


@query(f"WITH {ARTICLES} SELECT article_id, {strip('title')} <> {collapse('title')} AS spaced, CASE WHEN length({collapse('summary')}) <= {V.SUMMARY_CHARS} THEN {collapse('summary')} ELSE regexp_replace(substr({collapse('summary')}, 1, {V.SUMMARY_CHARS - 1}), '(?s)^(.+) [^ ]*$', '\\1') || '…' END AS summary FROM article")
def truncate_summary(spark, sf):
    title = F.col("title")
    return T.articles(spark, sf).select("article_id", (X.stripped(title) != X.collapsed(title)).alias("spaced"), X.truncated(F.col("summary")).alias("summary"))


@query("SELECT o_orderkey AS n, CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 100 BETWEEN 10 AND 20 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM orders")
def ordinals(spark, sf):
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), X.ordinal(F.col("o_orderkey")).alias("ordinal"))


@query()
def strip_html_text(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", arrow.html_text(F.col("html")).alias("text"))


MONEY = "text || ' $' || CAST(doc_id AS VARCHAR) || '.5M and ' || CAST(doc_id % 7 AS VARCHAR) || ' million'"


@query(f"SELECT doc_id, unnest(list_distinct(regexp_extract_all({MONEY}, {q('(?i)' + V.FIGURE)}))) AS figure FROM documents")
def figure_extract(spark, sf):
    text = F.concat("text", F.lit(" $"), F.col("doc_id").cast("string"), F.lit(".5M and "), (F.col("doc_id") % 7).cast("string"), F.lit(" million"))
    return T.table(spark, sf, "documents").select("doc_id", F.explode(X.figures(text)).alias("figure"))


@query(f"WITH {ARTICLES} SELECT article_id, {reason_sql()} AS reason FROM article")
def rejection_reason(spark, sf):
    return T.articles(spark, sf).select("article_id", news.rejection_reason(T.now(), community=COMMUNITY).alias("reason"))


@query(f"WITH {REASONS} SELECT article_id, title FROM reasoned WHERE reason IS NULL")
def newsworthy_keep(spark, sf):
    return news.drop_non_news(T.articles(spark, sf), T.now(), community=COMMUNITY).select("article_id", "title")


@query(f"WITH {REASONS} SELECT article_id, reason FROM reasoned WHERE reason LIKE 'community%'")
def community_opinion(spark, sf):
    return _reasons(spark, sf).where("reason LIKE 'community%'").select("article_id", "reason")


@query(f"WITH {ARTICLES}, {ORDINARY} SELECT word FROM ordinary WHERE word <> ''")
def ordinary_words(spark, sf):
    return news.ordinary_words(T.articles(spark, sf))


@query(f"WITH {ARTICLES} SELECT min(pos) AS pos, {collapse('lower(title)')} AS title FROM article GROUP BY 2")
def exact_title_dedup(spark, sf):
    return T.articles(spark, sf).groupBy(X.normalised_title(F.col("title")).alias("title")).agg(F.min("pos").alias("pos"))


@query()
def near_dup_pairs(spark, sf):
    return news.similar_titles(T.articles(spark, sf))


@query()
def near_dup_greedy(spark, sf):
    articles = T.articles(spark, sf)
    return news.deduplicated(articles, articles.where("pos % 10 = 3")).select("article_id", "title")


@query(f"WITH {ARTICLES} SELECT article_id FROM article WHERE article_id NOT IN (SELECT article_id FROM article WHERE pos % 10 = 3)")
def unseen_articles(spark, sf):
    articles = T.articles(spark, sf)
    return news.unseen(articles, articles.where("pos % 10 = 3")).select("article_id")


@query(f"SELECT doc_id, unnest({sents('text')}) AS sentence, generate_subscripts({sents('text')}, 1) - 1 AS sentence_pos FROM documents")
def sentence_split(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_pos", "sentence")).withColumn("sentence_pos", F.col("sentence_pos").cast("long"))


@query(f"SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest({names_of('text', 2)}) AS name FROM documents) GROUP BY ALL")
def proper_names(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.explode(grounding.named(F.col("text"))).alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query(f"WITH {ARTICLES} SELECT article_id, {fold('title')} AS folded FROM article")
def comparable_titles(spark, sf):
    return T.articles(spark, sf).select("article_id", X.comparable(F.col("title")).alias("folded"))


EVIDENCE = T.EVIDENCE
INDEX = f"""{EVIDENCE}, lower_case AS (SELECT DISTINCT conv_id, {norm_word('t')} AS word FROM (SELECT conv_id, unnest(list_concat({toks('title')}, {toks('summary')})) AS t FROM evidence) WHERE regexp_matches(t, '^\\p{{Ll}}')),
sourced AS (SELECT DISTINCT conv_id, unnest(flatten(list_transform(list_concat({sents('title')}, {sents('summary')}), lambda s: {scan('s', 2)}))) AS n FROM evidence),
spelled AS (SELECT conv_id, n, unnest({name_words(strip('n', '[ .,;:]'))}) AS word, generate_subscripts({name_words(strip('n', '[ .,;:]'))}, 1) AS i FROM sourced),
kept AS (SELECT conv_id, n, list(word ORDER BY i) AS words FROM spelled WHERE NOT EXISTS (SELECT 1 FROM lower_case o WHERE o.conv_id = spelled.conv_id AND o.word = spelled.word) GROUP BY ALL HAVING count(*) >= 2),
idx AS (SELECT conv_id, words[1] AS word, words FROM kept UNION ALL SELECT conv_id, words[-1], words FROM kept WHERE words[1] <> words[-1])"""


@query(f"WITH {INDEX} SELECT conv_id, word, count(*) AS names, sum(len(list_distinct(words))) AS words FROM idx GROUP BY ALL")
def name_index(spark, sf):
    index = grounding.name_index(T.evidence(spark, sf), "conv_id")
    return index.groupBy("conv_id", "word").agg(F.count("*").alias("names"), F.sum(F.size("words")).alias("words"))


def said(word: str) -> str:
    return f"regexp_matches(said, '(^|[^a-z0-9])' || regexp_escape({word}) || '([^a-z0-9]|$)')"


GROUNDED = f"""{INDEX}, src AS (SELECT conv_id, lower({fold("string_agg(title || ' ' || summary, ' ' ORDER BY pos, title, summary)")}) AS source FROM evidence GROUP BY conv_id),
nm AS (SELECT DISTINCT conv_id, unnest({names_of('summary', 2)}) AS name FROM claim), named AS (SELECT *, lower({fold('name')}) AS folded, {name_words('name')} AS words FROM nm WHERE name <> ''),
met AS (SELECT n.conv_id, n.name, i.word, list_distinct(n.words) AS mine, list_distinct(i.words) AS other FROM named n JOIN idx i ON n.conv_id = i.conv_id AND (i.word = n.words[1] OR i.word = n.words[-1])),
refuted AS (SELECT DISTINCT conv_id, name FROM met WHERE len(other) >= len(mine) GROUP BY conv_id, name, word HAVING bool_and(NOT list_has_all(other, mine) AND NOT list_has_all(mine, other))),
judged AS (SELECT n.*, coalesce(source, '') AS source, regexp_replace(coalesce(source, ''), '[''’](?:s\\b|\\b)', '', 'g') AS said, r.name IS NOT NULL AS refuted FROM named n LEFT JOIN src USING (conv_id) LEFT JOIN refuted r ON r.conv_id = n.conv_id AND r.name = n.name)"""


IS_GROUNDED = f"""CASE WHEN contains(source, folded) THEN true WHEN len(words) = 0 THEN false WHEN len(list_filter(words, lambda w: NOT list_contains({array(V.COMPETITION_WORDS)}, w))) = 0 THEN true
    WHEN refuted THEN false WHEN len(list_filter(words, lambda w: NOT {said('w')})) = 0 THEN true ELSE {said('words[-1]')} OR {said('words[1]')} END"""


@query(f"WITH {GROUNDED} SELECT conv_id, name, {IS_GROUNDED} AS grounded FROM judged")
def grounded_names(spark, sf):
    return grounding.ungrounded_names(T.claims(spark, sf), T.evidence(spark, sf), "conv_id")


@query(f"WITH {GROUNDED} SELECT conv_id, name FROM refuted")
def contradicted_names(spark, sf):
    claims, evidence = T.claims(spark, sf), T.evidence(spark, sf)
    names = claims.select("conv_id", F.explode(F.array_distinct(grounding.named(F.col("summary")))).alias("name")).where("name <> ''").withColumn("words", X.name_words(F.col("name"))).where(F.size("words") > 0)
    return grounding.contradicted(names, grounding.name_index(evidence, "conv_id"), "conv_id")


def keys_sql(x: str, least: int) -> str:
    words = f"list_transform({names_of(x, least)}, lambda n: {name_words('n')})"
    return f"list_transform(list_filter({words}, lambda w: len(w) > 0 AND len(list_filter(w, lambda v: NOT list_contains({array(V.COMPETITION_WORDS)}, v))) > 0), lambda w: w[-1])"


@query(
    f"""WITH {EVIDENCE}, k AS (SELECT conv_id, pos, unnest(list_distinct({keys_sql("title || ' ' || summary", 1)})) AS e FROM evidence), pairs AS (SELECT DISTINCT a.conv_id, a.e AS first, b.e AS second FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.pos = b.pos),
    s AS (SELECT conv_id, unnest({sents('summary')}) AS sentence, generate_subscripts({sents('summary')}, 1) - 1 AS sentence_pos FROM claim), e AS (SELECT conv_id, sentence_pos, sentence, unnest({keys_sql('sentence', 2)}) AS e, generate_subscripts({keys_sql('sentence', 2)}, 1) AS i FROM s),
    d AS (SELECT conv_id, sentence_pos, sentence, e, min(i) AS i FROM e GROUP BY ALL), p AS (SELECT a.conv_id, a.sentence_pos, a.sentence, a.e AS first, b.e AS second FROM d a JOIN d b ON a.conv_id = b.conv_id AND a.sentence_pos = b.sentence_pos AND a.i < b.i)
    SELECT DISTINCT conv_id, CAST(sentence_pos AS INTEGER) AS sentence_pos, {strip('sentence')} AS sentence FROM p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.conv_id = p.conv_id AND q.first = p.first AND q.second = p.second)"""
)
def unsupported_sentences(spark, sf):
    return grounding.unsupported_sentences(T.claims(spark, sf), T.evidence(spark, sf), "conv_id")


@query(
    f"""WITH {EVIDENCE}, c AS (SELECT conv_id, unnest(list_distinct(regexp_extract_all(summary || ' $' || CAST(conv_id % 40 AS VARCHAR) || 'M', {q('(?i)' + V.FIGURE)}))) AS figure FROM claim),
    d AS (SELECT conv_id, regexp_replace(string_agg(title || ' ' || summary, ' ' ORDER BY pos, title, summary), '[^0-9]', '', 'g') || CAST(conv_id AS VARCHAR) AS digits FROM evidence GROUP BY conv_id)
    SELECT conv_id, figure, regexp_replace(figure, '[^0-9]', '', 'g') = '' OR contains(coalesce(digits, ''), regexp_replace(figure, '[^0-9]', '', 'g')) AS grounded FROM c LEFT JOIN d USING (conv_id)"""
)
def figures_grounded(spark, sf):
    claims = T.claims(spark, sf).withColumn("summary", F.concat("summary", F.lit(" $"), (F.col("conv_id") % 40).cast("string"), F.lit("M")))
    held = T.evidence(spark, sf)
    last = held.groupBy("conv_id").agg(F.max("pos").alias("pos")).select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("conv_id").cast("string").alias("title"), F.lit("").alias("summary"))
    return grounding.ungrounded_figures(claims, held.unionByName(last), "conv_id")


@query(
    f"""WITH {GROUNDED}, unsaid AS (SELECT conv_id, list(name ORDER BY name) AS names FROM judged WHERE NOT {IS_GROUNDED} GROUP BY conv_id),
    told AS (SELECT conv_id, unnest(list_distinct(regexp_extract_all(summary, {q('(?i)' + V.FIGURE)}))) AS figure FROM claim),
    digits AS (SELECT conv_id, regexp_replace(source, '[^0-9]', '', 'g') AS digits FROM src),
    unheld AS (SELECT conv_id, list(figure ORDER BY figure) AS figures FROM told LEFT JOIN digits USING (conv_id) WHERE regexp_replace(figure, '[^0-9]', '', 'g') <> '' AND NOT contains(coalesce(digits, ''), regexp_replace(figure, '[^0-9]', '', 'g')) GROUP BY conv_id),
    v AS (SELECT claim.conv_id, coalesce(names, []) AS names, coalesce(figures, []) AS figures, regexp_matches({strip('summary')}, {q('(?i)' + V.PREAMBLE)}) AS has_preamble FROM claim LEFT JOIN unsaid USING (conv_id) LEFT JOIN unheld USING (conv_id))
    SELECT conv_id, array_to_string(names, '|') AS invented_names, array_to_string(figures, '|') AS invented_figures, has_preamble, len(names) = 0 AND len(figures) = 0 AS is_safe,
           coalesce(nullif(concat_ws('; ', CASE WHEN len(names) > 0 THEN 'invented names: ' || array_to_string(names, ', ') END, CASE WHEN len(figures) > 0 THEN 'invented figures: ' || array_to_string(figures, ', ') END, CASE WHEN has_preamble THEN 'preamble present' END), ''), 'clean') AS description FROM v"""
)
def validated_summaries(spark, sf):
    judged = grounding.validated(T.claims(spark, sf), T.evidence(spark, sf), "conv_id")
    return judged.withColumns({c: F.array_join(c, "|") for c in ("invented_names", "invented_figures")})


@query()
def safe_summaries(spark, sf):
    """Summaries of user turns from their titles, kept where their sources bear them out."""
    rows = T.evidence(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")) - 1)
    return summarize.safe_summaries(rows, "conv_id", [summarize.first_sentences])


@query(
    """WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
    cut AS (SELECT doc_id, t, list_transform(string_split(t, chr(10) || chr(10)), lambda b: {'done': list_transform(generate_series(0, (length(b) - 1) // 1000 - 1), lambda i: substr(b, i * 1000 + 1, 1000)), 'now': substr(b, greatest((length(b) - 1) // 1000, 0) * 1000 + 1), 'whole': b}) AS blocks FROM d),
    p AS (SELECT doc_id, t, list_reduce(blocks, lambda acc, x: CASE WHEN length(CASE WHEN acc.now = '' THEN x.whole ELSE acc.now || chr(10) || chr(10) || x.whole END) <= 1000
            THEN {'done': acc.done, 'now': CASE WHEN acc.now = '' THEN x.whole ELSE acc.now || chr(10) || chr(10) || x.whole END, 'whole': ''}
            ELSE {'done': list_concat(list_concat(acc.done, CASE WHEN acc.now = '' THEN [] ELSE [acc.now] END), x.done), 'now': x.now, 'whole': ''} END) AS r FROM cut),
    pieces AS (SELECT doc_id, CASE WHEN length(t) <= 1000 THEN [t] WHEN r.now = '' THEN r.done ELSE list_append(r.done, r.now) END AS made FROM p)
    SELECT doc_id, CAST(generate_subscripts(made, 1) - 1 AS INTEGER) AS piece_pos, unnest(made) AS piece FROM pieces"""
)
def message_chunks(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.posexplode(render.packed(F.replace("text", F.lit("\n"), F.lit("\n\n")), 1000)).alias("piece_pos", "piece"))


@query(f"WITH {ARTICLES} SELECT source, replace({q(V.ITEMS_HEAD.replace('{most}', str(V.BRIEF_CHARS)))}, '{{n}}', CAST(count(*) AS VARCHAR)) || chr(10) || chr(10) || string_agg('- ' || title || CASE WHEN {collapse('summary')} <> '' THEN chr(10) || '  ' || {collapse('summary')} ELSE '' END, chr(10) ORDER BY pos) AS prompt FROM article GROUP BY source")
def prompt_text(spark, sf):
    return render.prompt(T.articles(spark, sf), ["source"])


@query(f"WITH {ARTICLES}, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS place FROM article) SELECT source, CAST(place // {V.CHUNK} AS INTEGER) AS chunk, count(*) AS n, min(pos) AS first FROM p GROUP BY ALL")
def chunks_of_five(spark, sf):
    rows = T.articles(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("pos")) - 1)
    return summarize.in_chunks(rows).groupBy("source", "chunk").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query(f"""SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(replace(text, '. ', chr(10) || '- '), '\\r?\\n'), lambda l: {strip('l')}), lambda l: regexp_matches(l, '^[-*•]') OR (regexp_matches(l, '^[0-9]') AND contains(substr(l, 1, 3), '.')))) AS line FROM documents""")
def note_lines(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.explode(X.note_lines(F.replace("text", F.lit(". "), F.lit("\n- ")))).alias("line"))


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex({strip("replace(text, '. ', chr(10) || ' ' || chr(10))")}, '\\n[ \\t\\r\\f\\x0b]*\\n\\s*'), lambda p: {collapse('p')}), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM documents""")
def tidy_text(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.tidy(F.replace("text", F.lit(". "), F.lit("\n \n"))).alias("text"))


SCORE = "away_team || ' ' || CAST(away_score AS VARCHAR) || ' @ ' || home_team || ' ' || CAST(home_score AS VARCHAR)"
NOTE = f"""CASE WHEN meetings IS NULL THEN '' WHEN home_wins = away_wins THEN chr(10) || '   ' || o || ' meeting — series level at ' || CAST(home_wins AS VARCHAR) || '-' || CAST(away_wins AS VARCHAR)
    ELSE chr(10) || '   ' || o || ' meeting — ' || CASE WHEN home_wins > away_wins THEN home_team ELSE away_team END || ' led ' || CAST(greatest(home_wins, away_wins) AS VARCHAR) || '-' || CAST(least(home_wins, away_wins) AS VARCHAR) END"""
NTH = "CAST(meetings + 1 AS VARCHAR) || CASE WHEN (meetings + 1) % 100 BETWEEN 10 AND 20 THEN 'th' WHEN (meetings + 1) % 10 = 1 THEN 'st' WHEN (meetings + 1) % 10 = 2 THEN 'nd' WHEN (meetings + 1) % 10 = 3 THEN 'rd' ELSE 'th' END"


@query(f"WITH {H2H}, s AS (SELECT game.*, meetings, home_wins, away_wins, {NTH} AS o FROM game LEFT JOIN h2h USING (game_id)) SELECT CAST(CAST(start_time AS DATE) AS VARCHAR) AS day, 0 AS message_pos, {q(V.SCORES_HEAD)} || chr(10) || chr(10) || string_agg({SCORE} || '  (' || status || ')' || {NOTE}, chr(10) ORDER BY pos) AS text FROM s GROUP BY 1")
def scoreboard_messages(spark, sf):
    games = T.games(spark, sf).withColumn("day", F.to_date("start_time").cast("string"))
    return render.scoreboard(games, G.series_context(games, G.results_of(games)), ["day"])


WINNER = "CASE WHEN home_score > away_score THEN home_team ELSE away_team END"
CLAUSE = f"""CASE category WHEN 'comeback' THEN {WINNER} || ' came back from ' || largest_deficit_overcome || ' down' WHEN 'overtime' THEN {WINNER} || ' won in overtime' || CASE WHEN period > 5 THEN ' (' || (period - 4) || ' OT)' ELSE '' END
    WHEN 'closest_finish' THEN 'decided by ' || margin WHEN 'wire_to_wire' THEN {WINNER} || ' led at every break' WHEN 'second_half_takeover' THEN {WINNER} || ' outscored them by ' || second_half_swing || ' after half time'
    WHEN 'biggest_period' THEN 'a ' || biggest_period || '-point quarter' WHEN 'largest_margin' THEN {WINNER} || ' by ' || margin ELSE total_points || ' combined points' END"""
LABEL = "CASE category " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.CATEGORY_LABELS.items()) + " END"


@query(notable_sql() + f"SELECT CAST(day AS VARCHAR) AS day, 1 AS message_pos, {q(V.NOTABLE_HEAD)} || chr(10) || chr(10) || string_agg({LABEL} || ' — ' || {CLAUSE} || chr(10) || '   ' || {SCORE}, chr(10) || chr(10) ORDER BY list_position({array(V.CATEGORIES)}, category), pos) AS text FROM c8 WHERE category IS NOT NULL GROUP BY day")
def highlight_messages(spark, sf):
    games = T.games(spark, sf).withColumn("day", F.to_date("start_time").cast("string"))
    return render.highlights(G.notable_games(games, ["day"]), ["day"])


@query()
def brief_messages(spark, sf):
    """The whole brief of each of seven batches."""
    batch = lambda df: df.withColumn("batch", (F.col("pos") % 7).cast("int"))
    articles, games = batch(T.articles(spark, sf)), batch(T.games(spark, sf))
    seen = articles.where("pos % 10 = 3").select("article_id")
    states = games.where("game_id % 3 = 0").select(G.state_hash().alias("state_hash"))
    return brief(articles, games, seen, states, G.results_of(games), T.now(), ["batch"], community=COMMUNITY)


@query("SELECT event_id, min(ts) AS seen_at FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 4 = 0) GROUP BY event_id")
def seen_upsert(spark, sf):
    """First write wins: what an insert of all events adds to a state that knows a quarter of them."""
    events = T.table(spark, sf, "events").select("event_id", F.col("ts").alias("seen_at"))
    return state.newly_seen(events, events.where("event_id % 4 = 0"), "event_id")


@query(f"WITH {GAMES}, r AS (SELECT game_id % 500 AS game_id, home_team, away_team, home_score, away_score, status, game_id AS seq FROM game WHERE status = 'Final') SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY seq DESC) = 1")
def game_results_upsert(spark, sf):
    """Last write wins."""
    rows = G.results_of(T.games(spark, sf)).drop("played_on").withColumn("seq", F.col("game_id")).withColumn("game_id", F.col("game_id") % 500)
    return G.upserted(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), "game_id", "seq").select("game_id", "home_team", "away_team", "home_score", "away_score", "status", "seq")


@query("SELECT event_id FROM events GROUP BY event_id")
def stream_dedup(spark, sf):
    events = T.table(spark, sf, "events")
    return state.replayed(spark, sf, events.schema, lambda s: state.stream_unseen(s, "event_id").select("event_id"), "events.parquet")


@query("SELECT time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) AS window_start, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) + INTERVAL 1 DAY <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 168 HOUR FROM events) GROUP BY ALL")
def stream_window_counts(spark, sf):
    """Daily counts under a watermark of 168 hours: what is given out once the stream has ended."""
    events = T.table(spark, sf, "events")
    return state.replayed(spark, sf, events.schema, lambda s: state.stream_counts(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "168 hours", "event_type"), "events.parquet")


@query(
    """WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages), p AS (SELECT DISTINCT '/' || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS link FROM pages)
    SELECT page_id, link FROM l WHERE link LIKE '/%' AND link NOT IN (SELECT link FROM p)"""
)
def broken_links(spark, sf):
    return links.broken_page_links(T.table(spark, sf, "pages"))
