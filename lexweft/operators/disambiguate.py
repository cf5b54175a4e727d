"""The language-model step: prompts, calls through an injected client, parsing, fallback to the first candidate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.answers import answers_in_reasoning, parse_expansions
from ..functions.text import choice, expansion_prompt, mention_window, tree_category

# Fixed value: the question that a prompt ends with.
ASK = "Which candidate best matches the mention in the given context? Reply with ONLY the number."


def candidate_block(most_definition: int = 150, most_synonyms: int = 3) -> Column:
    """A candidate's lines in the prompt, from rank, preferred_label, entity_id, tree_numbers, definition, synonyms, score."""
    trees = F.filter(F.coalesce("tree_numbers", F.array().cast("array<string>")), lambda t: t != "")
    cats = F.array_join(F.array_sort(F.array_distinct(F.transform(trees, lambda t: tree_category(t, fixed.PROMPT_CATEGORY)))), ", ")
    d = F.coalesce("definition", F.lit(""))
    short = F.when(F.length(d) > most_definition, F.concat(F.substr(d, F.lit(1), F.lit(most_definition)), F.lit("..."))).otherwise(d)
    other = F.slice(F.filter("synonyms", lambda s: F.lower(s) != F.lower("preferred_label")), 1, most_synonyms)
    return F.concat_ws(
        "\n",
        F.concat(F.col("rank").cast("string"), F.lit(". **"), "preferred_label", F.lit("** ["), F.col("entity_id").cast("string"), F.lit("]")),
        F.when(F.size(trees) > 0, F.concat(F.lit("   Category: "), cats)),
        F.when(d != "", F.concat(F.lit("   Definition: "), short)),
        F.when(F.size(other) > 0, F.concat(F.lit("   Synonyms: "), F.array_join(other, ", "))),
        F.concat(F.lit("   Match score: "), F.format_string("%.1f", "score")),
        F.lit(""),
    )


def prompts(candidates: DataFrame, mentions: DataFrame, most: int = 10) -> DataFrame:
    """(mention_id, prompt, n): the first ``most`` candidates of each mention (mention_id, mention, context, title)."""
    c = candidates.filter(F.col("rank") <= most).select("mention_id", "rank", candidate_block().alias("lines"))
    blocks = c.groupBy("mention_id").agg(F.sort_array(F.collect_list(F.struct("rank", "lines"))).alias("b"), F.count("*").alias("n"))
    m = mentions.join(blocks, "mention_id")
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("**Title:** "), "title"))
    text = F.concat_ws("\n", F.lit("## Biomedical Text"), title, F.concat(F.lit("**Text:** "), "context"), F.lit(""), F.concat(F.lit('## Mention to Link: "'), "mention", F.lit('"')), F.concat(F.lit("**Context window:** "), mention_window("context", "mention")), F.lit(""), F.lit("## Candidates"), F.array_join(F.transform("b", lambda x: x["lines"]), "\n"), F.lit(ASK))
    return m.select("mention_id", text.alias("prompt"), "n")


def ask(rows: DataFrame, client: Callable[[], Callable[[str], str]], id_type: str = "long") -> DataFrame:
    """``rows`` (mention_id, prompt, n) with ``answer``; ``client`` runs once a worker; an error gives a null answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()

        def safe(p: str) -> str | None:
            try:
                return call(p)
            except Exception:
                return None

        for frame in frames:
            yield frame.assign(answer=frame["prompt"].map(safe))

    return rows.select("mention_id", "prompt", "n").mapInPandas(run, f"mention_id {id_type}, prompt string, n long, answer string")


def decide(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(mention_id, entity_id, chosen_rank, confidence): the chosen candidate, or the first one as a fallback."""
    picked = answers.select("mention_id", choice("answer", F.col("n").cast("int")).alias("c"))
    picked = picked.select("mention_id", F.coalesce("c", F.lit(1)).alias("rank"), F.when(F.col("c").isNull(), "fallback").otherwise("llm").alias("confidence"))
    return picked.join(candidates.select("mention_id", "rank", "entity_id"), ["mention_id", "rank"]).select("mention_id", "entity_id", F.col("rank").alias("chosen_rank"), "confidence")


def expand_abbreviations(mentions: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(upper, prompt, expansion, source): one call for each mention in capitals, with the first context by mention_id.

    source is llm or failed; an expansion must be longer than the mention.
    """
    w = Window.partitionBy("upper").orderBy("mention_id")
    one = mentions.withColumn("upper", F.upper("mention")).withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    asked = one.select("upper", "mention", expansion_prompt("mention", "context", "title").alias("prompt"))

    answered = ask(asked.select(F.col("upper").alias("mention_id"), "prompt", F.length("mention").cast("long").alias("n")), client, "string")
    term = F.coalesce(parse_expansions("answer"), answers_in_reasoning("answer"))
    found = answered.withColumn("expansion", F.when(F.length(term) > F.col("n"), term))
    return found.select(F.col("mention_id").alias("upper"), "prompt", "expansion", F.when(F.col("expansion").isNotNull(), "llm").otherwise("failed").alias("source"))


def call_statistics(mentions: DataFrame, results: DataFrame) -> DataFrame:
    """(calls, cached, expanded, failed): what a session cache would have counted."""
    n = mentions.agg(F.count("*").alias("mentions"))
    r = results.agg(F.count("*").alias("calls"), F.count_if(F.col("source") == "llm").alias("expanded"), F.count_if(F.col("source") == "failed").alias("failed"))
    return n.join(F.broadcast(r)).select("calls", (F.col("mentions") - F.col("calls")).alias("cached"), "expanded", "failed")  # one row each
