"""The provided tables, and the relations of this engine bound to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X

#: Up to and with the first full stop, or up to the end of the line.
FIRST_SENTENCE = r"^[^\n.!?]*[.!?]?"

#: The fixed clock of these bindings.
NOW = "2026-08-13 16:00:00"


#: Tables whose rows are long texts.
TEXTS = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the session's cores where a scan has fewer parts than there are, as that of one small file has; any larger table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _named(text):
    """Turns as texts with names: words whose length is no multiple of three get a capital."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when((F.length(w) % 3 > 0) & (F.substring(w, 1, 1) != "ß"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)), " ")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: the first sentence of the first line is the title, with names, and whatever follows it the summary; every so many titles get a tag, a phrase or a question mark."""
    n, text = F.col("doc_id"), F.col("text")
    first = F.regexp_extract(text, FIRST_SENTENCE, 0)
    title = X.let(_named(first), lambda line: F.when(n % 11 == 0, F.concat(F.lit("[Highlight] "), line)).when(n % 13 == 0, F.concat(F.lit("On This Day: "), line)).when(n % 17 == 0, F.concat(line, F.lit(" ?"))).when(n % 29 == 0, F.concat(F.lit("\u200b[Image ] "), line)).otherwise(line))
    author = F.when(n % 7 == 0, None).when(n % 19 == 0, F.concat("source", F.lit("_MOD"))).otherwise(F.concat(F.lit("/u/"), "source"))
    hours = (n * 37 % 400).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit(":"), n.cast("string")).alias("article_id"),
        title.alias("title"),
        F.concat(F.lit("https://example.com/"), n.cast("string")).alias("url"),
        F.substring(text, F.length(first) + 1, F.length(text)).alias("summary"),
        (now() - F.make_dt_interval(F.lit(0), hours)).alias("published_at"),
        author.alias("author"),
        "source",
        n.alias("pos"),
    )


NAMED = "array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) % 3 > 0 AND substr(w, 1, 1) <> 'ß' THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END), ' ')"
ARTICLES = f"""
    SELECT concat(source, ':', CAST(doc_id AS VARCHAR)) AS article_id,
           CASE WHEN doc_id % 11 = 0 THEN '[Highlight] ' || line WHEN doc_id % 13 = 0 THEN 'On This Day: ' || line
                WHEN doc_id % 17 = 0 THEN line || ' ?' WHEN doc_id % 29 = 0 THEN chr(8203) || '[Image ] ' || line ELSE line END AS title,
           substr(text, length(first) + 1) AS summary,
           TIMESTAMP '{NOW}' - to_hours(CAST(doc_id * 37 % 400 AS INTEGER)) AS published_at,
           CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN source || '_MOD' ELSE '/u/' || source END AS author,
           source, doc_id AS pos
    FROM (SELECT *, {NAMED.replace("text", "first", 1)} AS line FROM (SELECT *, regexp_extract(text, '{FIRST_SENTENCE}') AS first FROM documents))
"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as games, their lines as periods, the customer's nation against another."""
    per_line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.sum("l_quantity").cast("int").alias("h"), F.sum(F.col("l_partkey") % 40).cast("int").alias("a"))
    lines = per_line.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "h", "a"))).alias("p"))  # at most seven a game
    nation, customer, orders = (table(spark, sf_dir, x) for x in ("nation", "customer", "orders"))
    home = nation.select(F.col("n_nationkey").alias("hk"), F.col("n_name").alias("home_team"))
    away = nation.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("away_team"))
    held = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("k"))
    held = held.join(F.broadcast(home), F.col("c_nationkey") == F.col("hk")).join(F.broadcast(away), F.col("ak") == (F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25)  # 25 nations
    side = lambda x: F.transform("p", lambda s: s[x])
    total = lambda x: F.aggregate("p", F.lit(0), lambda acc, s: acc + s[x])
    status = F.when(F.col("o_orderstatus") == "F", "Final").when(F.col("o_orderstatus") == "O", "Scheduled").otherwise("In Progress")
    return held.select(F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").cast("timestamp").alias("start_time"), status.alias("status"), "home_team", "away_team", total("h").alias("home_score"), total("a").alias("away_score"), F.size("p").alias("period"), side("h").alias("home_periods"), side("a").alias("away_periods"), F.col("o_orderkey").alias("pos"))


GAMES = """
    SELECT o_orderkey AS game_id, CAST(o_orderdate AS TIMESTAMP) AS start_time,
           CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Scheduled' ELSE 'In Progress' END AS status,
           hn.n_name AS home_team, an.n_name AS away_team, home_score, away_score, period, home_periods, away_periods, o_orderkey AS pos
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation hn ON hn.n_nationkey = c_nationkey
    JOIN nation an ON an.n_nationkey = (c_nationkey + 1 + o_orderkey % 24) % 25
    JOIN (SELECT k, CAST(sum(h) AS INTEGER) AS home_score, CAST(sum(a) AS INTEGER) AS away_score, CAST(count(*) AS INTEGER) AS period,
                 list(h ORDER BY n) AS home_periods, list(a ORDER BY n) AS away_periods
          FROM (SELECT l_orderkey AS k, l_linenumber AS n, CAST(sum(l_quantity) AS INTEGER) AS h, CAST(sum(l_partkey % 40) AS INTEGER) AS a
                FROM lineitem GROUP BY ALL) GROUP BY k) ON k = o_orderkey
"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as summaries: (conv_id, summary)."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("text", _named(F.col("text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("summary"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as articles: (conv_id, pos, title, summary); first line and rest."""
    text, turns = F.col("text"), table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("text", _named(F.col("text")))
    line = F.split_part(text, F.lit("\n"), F.lit(1))
    return turns.select("conv_id", F.col("turn").alias("pos"), line.alias("title"), F.substring(text, F.length(line) + 2, 1 << 30).alias("summary"))


EVIDENCE = f"""turn AS (SELECT conv_id, turn, role, {NAMED} AS text FROM conversations),
evidence AS (SELECT conv_id, turn AS pos, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS summary FROM turn WHERE role = 'user'),
claim AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS summary FROM turn WHERE role = 'assistant' GROUP BY conv_id)"""
