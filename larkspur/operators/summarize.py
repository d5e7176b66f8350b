"""Written summaries: a callable writes, the sources judge, and what is not safe is written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X, values as V
from .grounding import validated
from .render import prompt, reduce_prompt


def first_sentences(text: str, most: int = V.BRIEF_CHARS) -> str:
    """A writer that needs no model: the stories' titles as sentences."""
    titles = [line[2:].strip() for line in text.splitlines() if line.startswith("- ")]
    out = ""
    for title in titles:
        sentence = title if title.endswith((".", "!", "?")) else title + "."
        if len(out) + len(sentence) + 1 > most:
            break
        out = f"{out} {sentence}".strip()
    return out


def in_chunks(articles: DataFrame, chunk: int = V.CHUNK) -> DataFrame:
    """Articles with `chunk`, of so many on end. `place` numbers a batch's articles from 0."""
    return articles.withColumn("chunk", F.floor(F.col("place") / chunk).cast("int"))


def chunked_prompts(articles: DataFrame, batch: list[str], chunk: int = V.CHUNK, most: int = V.BRIEF_CHARS) -> DataFrame:
    """(batch..., chunk, prompt): prompts over so many stories on end."""
    return prompt(in_chunks(articles, chunk), [*batch, "chunk"], most)


def written(articles: DataFrame, batch: list[str], write: Callable[[str], str | None], chunk: int = V.CHUNK, most: int = V.BRIEF_CHARS) -> DataFrame:
    """(batch..., summary): a batch of at most `chunk` stories is written at once; of a larger one the chunks' notes first, then the whole."""
    ask = F.udf(lambda p: _ask(write, p), "string")  # a call a prompt, as a model is asked
    places = articles.groupBy(*batch).agg(F.count("*").alias("n"))
    small = prompt(articles.join(places.where(F.col("n") <= chunk), batch), batch, most).select(*batch, ask("prompt").alias("summary"))
    notes = chunked_prompts(articles.join(places.where(F.col("n") > chunk), batch), batch, chunk, most).select(*batch, "chunk", ask("prompt").alias("note"))
    listed = notes.groupBy(*batch).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "note"))), lambda x: F.coalesce(x["note"], F.lit(""))).alias("notes"))
    large = listed.select(*batch, ask(reduce_prompt(F.col("notes"), most)).alias("summary"))
    return small.unionByName(large).select(*batch, X.tidy(F.col("summary")).alias("summary"))


def _ask(write: Callable[[str], str | None], text: str) -> str | None:
    try:
        return write(text) or None
    except Exception:  # a failed call is an attempt, not an end
        return None


def safe_summaries(articles: DataFrame, key: str, writers: list[Callable[[str], str | None]], vocabulary: DataFrame | None = None, chunk: int = V.CHUNK, most: int = V.BRIEF_CHARS) -> DataFrame:
    """(key, summary, attempt): for each batch the first attempt that says nothing its sources don't; batches without one aren't there.

    One writer stands for one attempt. Batches with a safe text aren't written again.
    """
    from ..streaming.state import cut

    done, left = None, articles
    for attempt, write in enumerate(writers):
        texts = cut(written(left, [key], write, chunk, most).where("summary <> ''"))
        good = validated(texts, left, key, vocabulary).where("is_safe").select(key)
        found = cut(texts.join(good, key, "left_semi").withColumn("attempt", F.lit(attempt)))
        done = found if done is None else done.unionByName(found)
        left = left.join(found.select(key), key, "left_anti")
    return done
