"""Retrieval-augmented answers: prompts, responses, highlights and the engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embedding import Provider, embed
from .vectors import search

#: How a source and a prompt are laid out; {} stand for the values.
SOURCE = "\n        ```\n        source_id: {}\n        source_text: {}\n        ```\n        "
PROMPT = "\nYou will be given a message from a user and a list of sources, \nthat may be relevant to answering the question.\nYour job is to answer the question.\n\nHere is the question:\n{}\n\nSources:\n{}\n"

#: Fixed value: what the model is told before the prompt.
SYSTEM = """
You are a helpful assistant.

You are given a message from a user and a list of citations.
If the citations are relevant to the message, you should use them to answer the question.

ONLY RESPOND IN JSON.

Please respond in the same language as the message from the user.
"""

#: The fields of an answer, as a JSON schema for the model and as Spark's schema.
RESPONSE_SCHEMA = {
    "type": "object",
    "properties": {
        "response": {"type": "string"},
        "source_ids": {"type": "array", "items": {"type": "string"}},
        "highlighted_response": {"type": "array", "items": {"type": "object", "additionalProperties": {"type": "string"}}},
    },
    "required": ["response", "source_ids", "highlighted_response"],
}
RESPONSE = "response STRING, source_ids ARRAY<STRING>, highlighted_response ARRAY<MAP<STRING,STRING>>"


def filled(template: str, *values: Column) -> Column:
    """A template with values in place of its {}."""
    first, *rest = template.split("{}")
    return F.concat(F.lit(first), *[part for value, text in zip(values, rest, strict=True) for part in (value, F.lit(text))])


def source_block(source_id: Column, text: Column) -> Column:
    return filled(SOURCE, source_id, text)


def prompts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, prompt): the sources of each question by rank, separated by an empty line. hits: qid, rank, id, chunk_text."""
    blocks = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", source_block(F.col("id"), F.col("chunk_text")).alias("block")))).alias("blocks"))
    listed = F.coalesce(F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit(""))
    return questions.join(blocks, "qid", "left").select("qid", filled(PROMPT, F.col("question"), listed).alias("prompt"))


def parse_response(answer: Column, strict: bool = True) -> Column:
    """The answer's fields. An answer that is no JSON, or lacks a field, fails if strict and is null otherwise."""
    parsed = F.from_json(answer, RESPONSE, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    whole = parsed["response"].isNotNull() & parsed["source_ids"].isNotNull() & parsed["highlighted_response"].isNotNull()
    if strict:
        return F.when(whole, parsed).otherwise(F.raise_error(F.lit("an answer lacks a field")))
    return F.when(whole, parsed)


def highlight(response: Column, spans: Column, names: Column) -> Column:
    """response with each span {source_id: text} marked, one after the other. names: map of source id to name."""
    entries = F.flatten(F.transform(spans, F.map_entries))

    def mark(text: Column, e: Column) -> Column:
        name = F.coalesce(F.try_element_at(names, e["key"]), F.lit("Unknown"))
        return F.replace(text, e["value"], F.concat(F.lit('<mark title="'), name, F.lit('">'), e["value"], F.lit(" ["), e["key"], F.lit("]</mark>")))

    return F.aggregate(entries, response, mark)


@dataclass
class Engine:
    """Questions to answers over a table of vectors and one of chunks.

    llm: from conversations (lists of messages with role and content) and the JSON schema of an answer to answers as JSON, one for each.
    """

    vectors: DataFrame
    chunks: DataFrame
    embedder: Provider
    llm: Callable[[list[list[dict[str, str]]], dict], list[str]]
    languages: tuple[str, ...] = ("icelandic",)
    system: str = SYSTEM

    def answer(self, questions: DataFrame, language: str, namespace: str | None = None, top_k: int = 5) -> DataFrame:
        """(qid, question, answer struct, chunks array) for (qid, question)."""
        if language not in self.languages:
            raise ValueError(f"Unsupported language: {language}")
        vectors = questions.select("qid", embed(F.col("question"), self.embedder).alias("vector"))
        hits = search(vectors, self.vectors, top_k, namespace).join(self.chunks, "id")
        asked = prompts(hits, questions)
        llm, system = self.llm, {"role": "system", "content": self.system}

        @F.arrow_udf("string")
        def complete(batch):
            import pyarrow as pa

            found = llm([[system, {"role": "user", "content": prompt}] for prompt in batch.to_pylist()], RESPONSE_SCHEMA)
            if len(found) != len(batch):
                raise ValueError(f"{len(found)} answers for {len(batch)} prompts")
            return pa.array(found, pa.string())

        answers = asked.select("qid", parse_response(complete("prompt")).alias("answer"))
        used = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "chunk_text", "score"))).alias("chunks"))
        return questions.join(answers, "qid").join(used, "qid", "left")


class EchoModel:
    """An offline stand-in for a language model: cites every source of the last message."""

    def __call__(self, conversations: list[list[dict[str, str]]], schema: dict) -> list[str]:
        import json

        out = []
        for messages in conversations:
            ids = re.findall(r"source_id: (\S+)", messages[-1]["content"])
            out.append(json.dumps({"response": "See the sources.", "source_ids": ids, "highlighted_response": [{i: "sources"} for i in ids[:1]]}))
        return out


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Place (from 0) of each row within its document."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
