"""Line dedup by a log-template tree: records whose template recurs in other documents are dropped after their first document.

A record is a line, or a sentence within a line of several, since passages are often pasted between other sentences. Tokens
with digits are variable fields. The tree has a fixed depth: a record goes down by its number of tokens, then by its leading
third of tokens, its middle third and its last third. A node is generalised where the corpus shows that it varies: where
rows of at least ``VARIED_ROWS`` documents agree in all thirds but one and that third takes different values, the third is a
variable field, and all of them share the template without it.

One rule drops: a record goes from every document but the one with the smallest id where its template recurs, plain in two
documents or with a variable third. A line needs a token for each third, so that shorter ones have no template; a sentence
within a line, and a record with a variable third, need two, since below that equal words are coincidence. A record of
variable fields alone has none. Templates are 64-bit hashes, counted over all documents; no template's documents ever meet in
one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

#: Levels of the tree below the number of tokens; tokens of a line, and of a sentence or a record with a variable part.
PARTS = 3
LEAST_LINE, LEAST_SENTENCE = PARTS, 2 * PARTS
#: Documents whose records make a part variable.
VARIED_ROWS = 3
#: A template is common if over one in so many filed rows has it; so fewer than that many are.
COMMON_OF = 10_000

_digit = re.compile(r"\d").search
# Odd factors that keep the parts' hashes apart.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_MASK, _HALF = (1 << 64) - 1, 1 << 63


def masked(record: str) -> list[str]:
    """A record's tokens, those with digits as variable fields."""
    tokens = record.rstrip(". \t\r").split()
    return ["<*>" if _digit(t) else t for t in tokens] if _digit(record) else tokens


def sentences(line: str) -> list[str]:
    return line.split(". ")


class Templates:
    """Template hashes of a text: of each line those of the whole, with the thirds' values, and of each sentence."""

    def __init__(self, text: str):
        from xxhash import xxh64_intdigest as digest

        #: Of each line: (its plain template, [(template with a variable third, that third's hash)]), and its sentences' templates.
        self.lines: list[tuple[int | None, list[tuple[int, int]]]] = []
        self.sentences: list[list[int | None]] = []
        for line in text.split("\n"):
            parts = sentences(line) if ". " in line else ()
            own = [masked(p) for p in parts] if parts else [masked(line)]
            # a line's tokens are its sentences' tokens, whose full stops are left out alike
            tokens = [t for p in own for t in p] if parts else own[0]
            n = len(tokens)
            if n < LEAST_LINE or tokens.count("<*>") == n:
                self.lines.append((None, []))
            else:
                cuts = [n * i // PARTS for i in range(PARTS + 1)]
                hashes = [digest(" ".join(tokens[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
                whole = n * _FACTORS[PARTS] + sum(h * f for h, f in zip(hashes, _FACTORS, strict=False))
                varied = []
                if n >= LEAST_SENTENCE:
                    varied = [((whole - h * f + i + 1 & _MASK) - _HALF, h & 0x7FFFFFFF) for i, (h, f) in enumerate(zip(hashes, _FACTORS, strict=False)) if tokens.count("<*>") < n - (cuts[i + 1] - cuts[i])]
                self.lines.append(((whole & _MASK) - _HALF, varied))
            self.sentences.append([digest(" ".join(p)) - _HALF if len(p) >= LEAST_SENTENCE and p.count("<*>") < len(p) else None for p in own] if parts else [])

    def filed(self) -> dict[int, int | None]:
        """Distinct templates with the variable third's value (None: no part is variable)."""
        found: dict[int, int | None] = {}
        for plain, varied in self.lines:
            if plain is not None:
                found[plain] = None
            for template, value in varied:
                found.setdefault(template, value)
        for own in self.sentences:
            found.update((t, None) for t in own if t is not None)
        return found


def _filed(docs: DataFrame) -> DataFrame:
    """(doc_id, template, value): the distinct templates of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, templates, values = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Templates(text).filed() if text else {}
                templates += found.keys()
                values += found.values()
                ids += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(templates, pa.int64()), pa.array(values, pa.int32())], ["doc_id", "template", "value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, template long, value int")


def recurring(docs: DataFrame) -> DataFrame:
    """(doc_id, found array<template>): templates that a document shares with one of a smaller id."""
    filed = materialize(_filed(docs), "line-templates", "lz4")
    counts = filed.groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("value").alias("low"), F.max("value").alias("high"))
    again = counts.where(f"first < last and (low is null or n >= {VARIED_ROWS} and low < high)").select("template", "n", "first")
    again = materialize(again, "line-recurring", "lz4")
    # common templates are few by their definition and are sent to all tasks, so that none of them meets in one task
    common = F.col("n") * COMMON_OF > filed.count()
    sent = F.broadcast(again.where(common).select("template", F.col("first").alias("common_first")))
    both = filed.select("doc_id", "template").join(sent, "template", "left")
    rare = both.where("common_first is null").select("doc_id", "template").join(again.where(~common).select("template", "first"), "template")
    later = rare.where("doc_id > first").select("doc_id", "template").unionByName(both.where("doc_id > common_first").select("doc_id", "template"))
    return later.groupBy("doc_id").agg(F.collect_set("template").alias("found"))


def without(text: str, found: set[int]) -> tuple[str, int]:
    """(text without the records of recurring templates, how many were dropped)."""
    own = Templates(text)
    lines, dropped = [], 0
    for line, (plain, varied), parts in zip(text.split("\n"), own.lines, own.sentences, strict=True):
        if plain in found or any(t in found for t, _ in varied):
            dropped += 1
            continue
        if any(t in found for t in parts):
            gone = [t in found for t in parts]
            dropped += sum(gone)
            kept = [p for p, g in zip(sentences(line), gone, strict=True) if not g]
            if not any(p.strip() for p in kept):
                continue
            line = ". ".join(kept) + "." * (gone[-1] and not kept[-1].rstrip().endswith("."))
        lines.append(line)
    return ("\n".join(lines), dropped) if dropped else (text, 0)


def drop_recurring_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with recurring records taken out of ``text``, all columns and rows kept.

    ``counts`` adds ``n_dropped`` (in place of a column of that name). Null texts stay null, and rows with a null id stay as
    they are and count for nothing; rows with the same id count as one document, which keeps or loses its records in all of
    them. Of equal records in the document that keeps them, all stay. A text of which nothing is left is empty.
    """
    names = [c for c in docs.columns if not (counts and c == "n_dropped")]
    docs = docs.select(names)
    at, many = names.index("text"), len(names)
    key, found_col = (next(f"__{c}{i}" for i in range(len(names) + 1) if f"__{c}{i}" not in names) for c in ("id", "found"))
    found = recurring(docs).select(F.col("doc_id").alias(key), F.col("found").alias(found_col))
    both = docs.where("doc_id is not null").join(found, docs["doc_id"] == found[key], "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped = [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(many).to_pylist(), strict=True):
                text, n = without(text, set(own)) if own and text else (text, 0)
                texts.append(text)
                dropped.append(n)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(many)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(dropped, pa.int64())] * counts, names + ["n_dropped"] * counts)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    made = both.mapInArrow(run, fields + ", n_dropped long" * counts)
    unnamed = docs.where("doc_id is null")
    return made.unionByName(unnamed.withColumn("n_dropped", F.lit(0).cast("long")) if counts else unnamed)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs, counts=True)
