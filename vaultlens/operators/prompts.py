"""Prompts for an external rewriter, and the batches in which it is asked.

The texts are ours; what they carry is the data a reviewer needs. The rewriter
is a callable from prompt to reply that the caller supplies.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vaultlens.functions import replies
from vaultlens.functions import text as T
from vaultlens.plans.runtime import numbered

Rewriter = Callable[[str], str]


def import_prompts(sections: DataFrame, instructions: str, tags: list[str]) -> DataFrame:
    """source_file, section_idx and prompt for each section of parsed documents."""
    doc = F.to_json(F.struct("source_file", "heading", "level", "paragraphs"))
    head = F.lit(f"{instructions}\n\nAllowed tags: {', '.join(tags)}\n\nDocument:\n")
    return sections.select("source_file", "section_idx", F.concat(head, doc).alias("prompt"))


def note_prompts(notes: DataFrame, instructions: str, tags: list[str]) -> DataFrame:
    """note_id and prompt for notes that are to be enriched or split."""
    head = F.lit(f"{instructions}\n\nAllowed tags: {', '.join(tags)}\n\n")
    return notes.select("note_id", F.concat(head, F.lit("Title: "), F.col("title"), F.lit("\n\n"), F.col("body")).alias("prompt"))


def group_prompts(groups: DataFrame, notes: DataFrame, *, words: int = 300, size: int = 5) -> DataFrame:
    """batch, groups (their ids) and prompt: candidate groups, so many in each batch but the last, with the first words of each note.

    groups has group_id and notes (array<bigint>). Batches follow the order of
    group ids; a group's part of the prompt is assembled first, in the order
    of note ids.
    """
    g = groups.select("group_id", F.explode(F.array_distinct("notes")).alias("note_id"))
    part = F.concat(F.lit("### "), F.col("title"), F.lit("\nTags: "), F.array_join(F.array_sort("tags"), ", "), F.lit("\nSource: "), F.col("source_doc"), F.lit("\nWords: "), F.col("words").cast("string"), F.lit("\n\n"), T.first_words("body", words))
    j = g.join(notes, "note_id").groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_id", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))
    b = numbered(j, "group_id").withColumn("batch", F.floor(F.col("number") / size))
    return b.groupBy("batch").agg(F.array_sort(F.collect_list("group_id")).alias("groups"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_id", F.concat(F.lit("## Group "), F.col("group_id").cast("string"), F.lit("\n\n"), "text").alias("t")))), lambda x: x["t"]), "\n\n---\n\n").alias("prompt"))


#: What a reviewer answers for each group and each pair.
GROUP_REPLY = "groups array<struct<group_id bigint, is_duplicate boolean, confidence double, canonical_title string, canonical_tags array<string>, canonical_body string>>"
PAIR_REPLY = "pairs array<struct<pair_id bigint, action string, confidence double, canonical_title string, canonical_tags array<string>, canonical_body string>>"


def match_groups(replied: DataFrame) -> DataFrame:
    """batch and the verdicts of groups: each answer that names a group of its own batch.

    replied has batch, groups (the ids asked) and payload. An unparsable reply
    decides nothing, unknown groups are left out, and a group that a reply
    leaves out stays undecided. No verdict is none, no confidence is 0.
    """
    found = replied.select("batch", "groups", F.explode(F.from_json("payload", GROUP_REPLY)["groups"]).alias("x")).where(F.array_contains("groups", F.col("x.group_id")))
    of = {"is_duplicate": F.coalesce("is_duplicate", F.lit(False)), "confidence": F.coalesce("confidence", F.lit(0.0))}
    return found.select("batch", "x.*").withColumns(of)


def match_pairs(replied: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, ...) with action, confidence and the canonical fields that replies (payload) give them; unknown ids are ignored."""
    x = replied.select(F.explode(F.from_json("payload", PAIR_REPLY)["pairs"]).alias("x")).select("x.*")
    of = {"action": F.coalesce("action", F.lit("ignore")), "confidence": F.coalesce("confidence", F.lit(0.0))}
    return pairs.join(x.withColumns(of), "pair_id")


def pair_prompts(pairs: DataFrame, *, words: int = 220) -> DataFrame:
    """a, b and prompt for similar pairs with titles, tags and bodies."""
    side = lambda x: F.concat(F.lit(f"### {x.upper()}: "), F.col(f"title_{x}"), F.lit("\n\n"), T.first_words(f"body_{x}", words))
    return pairs.select("a", "b", F.concat(F.lit("Score: "), F.col("score").cast("string"), F.lit("\n\n"), side("a"), F.lit("\n\n"), side("b")).alias("prompt"))


def command_rewriter(argv: list[str], timeout: float = 300.0) -> Rewriter:
    """A rewriter that gives the prompt to a program and takes its output; one that fails or takes too long has failed."""

    def run(prompt: str) -> str:
        return subprocess.run(argv, input=prompt, capture_output=True, text=True, encoding="utf-8", timeout=timeout, check=True).stdout

    return run


def choose_rewriter(rewriters: dict[str, list[str]], asked: str = "auto", variable: str = "VAULTLENS_REWRITER", timeout: float = 300.0) -> tuple[str, Rewriter]:
    """Name and rewriter of the program to ask: the one named, else that of the environment, else the first that is installed."""
    name = asked if asked != "auto" else os.environ.get(variable, "auto")
    if name == "auto":
        name = next((n for n, argv in rewriters.items() if shutil.which(argv[0])), "")
    if name not in rewriters:
        raise ValueError(f"no such rewriter: {name or 'none is installed'}")
    return name, command_rewriter(rewriters[name], timeout)


def ask(prompts: DataFrame, rewriter: Rewriter, *, tries: int = 3, wait: float = 2.0, continuations: int = 2, tail: int = 8000) -> DataFrame:
    """prompts with reply (null where the rewriter failed) and payload (its JSON, null if unparsable).

    Failures are repeated with doubled waits. A reply that looks truncated is
    continued with its own tail as context. A task that is run again asks
    again; a caller whose rewriter has side effects must key them by prompt.
    """
    schema = StructType([*prompts.schema.fields, StructField("reply", StringType())])

    def one(prompt: str) -> str | None:
        for k in range(tries):
            try:
                out = rewriter(prompt)
                for _ in range(continuations):
                    if not replies.breaks_off(out):
                        break
                    out += rewriter("Continue exactly where this ends:\n" + out[-tail:])
                return out
            except Exception:  # whatever the rewriter raises counts as a failed try
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return None

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(reply=[one(p) for p in pdf["prompt"]])

    return prompts.mapInPandas(rows, schema).withColumn("payload", replies.reply_json(replies.fenced("reply")))
