"""Line dedup with a tree of line templates.

The tree has a fixed depth: a line goes to the leaf of its number of tokens
and its leading tokens, tokens with digits standing for any such token.
Inside a leaf a token is constant at its position by its share of the leaf's
documents there, and a variable field otherwise. Half of them is enough; where
a line is not mostly constant by that, the share is lowered until it is, so
that a rare template beside a common one is judged by its own constants, and
values of its fields, however often they come, by their share against them. A
line belongs to the template of its constants; one that is not mostly constant
at any share of ``min_docs`` documents is its own template.
Lines of a template that recurs across documents are dropped; its first line
(by doc_id) stays, so that no passage leaves the corpus altogether.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BLANKS, IS_BLANK, _power_table, byte_classes, bytes_of, cut, let, limit_batches, mix, row_hash, runs, span_hashes

DEPTH = 3
_DIGIT = byte_classes(b"0123456789") == 1
_FIELD = np.uint64(0x5851F42D4C957F2D)


class Lines:
    """Lines with a word of a text: number in the text, tokens, hash of the line and of its leaf."""

    def __init__(self, data: bytes, depth: int = DEPTH) -> None:
        buffer = np.frombuffer(data, np.uint8)
        starts, ends = runs((~IS_BLANK[buffer]).view(np.uint8))
        words = span_hashes(data, starts, ends)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[buffer])])
        self.masked = np.where(digits[ends] > digits[starts], _FIELD, words)
        line = np.searchsorted(np.flatnonzero(buffer == 10), starts)
        self.first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
        self.numbers = line[self.first]
        self.tokens = np.diff(np.concatenate([self.first, [len(words)]]))
        inside = np.arange(len(words)) - np.repeat(self.first, self.tokens)
        powers = _power_table(int(self.tokens.max()) if len(self.tokens) else 1)
        add = lambda values: np.add.reduceat(values, self.first) if len(self.first) else np.empty(0, np.uint64)
        self.hashes = mix(add(words * powers[inside]))
        self.leaves = mix(add(np.where(inside < depth, self.masked, np.uint64(0)) * powers[inside]) ^ self.tokens.astype(np.uint64))

    def field_tokens(self, k: int) -> np.ndarray:
        return self.masked[self.first[k] : self.first[k] + self.tokens[k]]


def _occurrences(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, content, line, tokens, leaf, hash: one row per different line of a document; the lines of a text stay out."""

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            owner, parts = [], []
            for k, data in enumerate(bytes_of(batch.column("text"))):
                found = Lines(data, depth)
                owner += [k] * len(found.numbers)
                parts.append((found.numbers, found.tokens, found.leaves.view(np.int64), found.hashes.view(np.int64)))
            rows = pa.array(owner, pa.int64())
            columns = [pa.array(np.concatenate(c).astype(np.int64)) if parts else pa.array([], pa.int64()) for c in zip(*parts, strict=True)] if parts else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("content").take(rows), *columns], ["doc_id", "content", "line", "tokens", "leaf", "hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "content", "text").mapInArrow(parse, f"doc_id {kind}, content long, line long, tokens long, leaf long, hash long")


def _field_tokens(docs: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """leaf, hash, docs, all_docs, parts: the tokens of the wanted lines (content, line, docs, all_docs), one row per different line."""
    lists = wanted.groupBy("content").agg(F.collect_list(F.struct("line", "docs", "all_docs")).alias("wanted"))

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for data, wanted in zip(bytes_of(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                found = Lines(data, depth)
                for item in wanted:
                    k = int(np.searchsorted(found.numbers, item["line"]))
                    rows.append((int(found.leaves[k].view(np.int64)), int(found.hashes[k].view(np.int64)), item["docs"], item["all_docs"], found.field_tokens(k).view(np.int64).tolist()))
            leaf, line, docs_, all_docs, tokens = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(line, pa.int64()), pa.array(docs_, pa.int64()), pa.array(all_docs, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["leaf", "hash", "docs", "all_docs", "parts"])

    texts = docs.select("content", "text").join(lists, "content").select("text", "wanted")
    # equal rows of a document parse its lines twice
    return texts.mapInArrow(parse, "leaf long, hash long, docs long, all_docs long, parts array<long>").dropDuplicates(["leaf", "hash"])


def needed(tokens: Column, min_docs: int, long_tokens: int) -> Column:
    return F.when(tokens >= long_tokens, F.lit(2)).otherwise(F.lit(min_docs))


def recurring_lines(docs: DataFrame, *, min_docs: int = 3, long_tokens: int = 30, constant: float = 0.6, depth: int = DEPTH) -> DataFrame:
    """content, line: the lines to drop. ``docs`` has doc_id, content (its key) and text.

    A template recurs if ``min_docs`` documents have it, or two for lines of
    ``long_tokens`` tokens and more. Counts are taken over different lines
    first, so a line that a third of all documents have is one row a task
    before the shuffle. Only lines of leaves that hold several different
    lines are looked at token by token.
    """
    limit_batches(docs.sparkSession)
    seen = cut(_occurrences(docs, depth))
    # one row per different line: how many documents have it, and one place where it stands
    lines = seen.groupBy("leaf", "hash").agg(F.count_distinct("content").alias("docs"), F.min(F.struct("content", "line")).alias("place"), F.max("tokens").alias("tokens"))
    lines = cut(lines)
    mixed = lines.groupBy("leaf").agg(F.count("*").alias("different"), F.sum("docs").alias("all_docs"), F.max("tokens").alias("leaf_tokens")).filter(
        (F.col("different") > 1) & (F.col("all_docs") >= needed(F.col("leaf_tokens"), min_docs, long_tokens)) & (F.col("leaf_tokens") > depth)
    )
    wanted = lines.join(mixed.select("leaf", "all_docs"), "leaf").select("place.content", "place.line", "docs", "all_docs")
    fields = cut(_field_tokens(docs, wanted, depth)).select("leaf", "hash", "docs", "all_docs", F.size("parts").alias("tokens"), F.posexplode("parts").alias("place", "token"))
    have = F.least(F.sum("docs"), F.ceil(F.max("all_docs") / 2))
    stable = fields.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("docs"), have.alias("have"), F.max("tokens").alias("tokens")).filter(
        F.col("docs") >= needed(F.col("tokens"), min_docs, long_tokens)
    )
    mark = F.struct("have", (F.col("token") != int(_FIELD)).alias("word"), F.xxhash64("place", "token").alias("code"))
    marks = (
        fields.select("leaf", "hash", "tokens", "place", "token").join(stable.select("leaf", "place", "token", "have"), ["leaf", "place", "token"])
        .groupBy("leaf", "hash", "tokens").agg(F.collect_list(mark).alias("marks"))
    )
    # so many constants make a line of a template; the last of them sets how many documents a constant of the line has
    least = F.ceil(F.lit(constant) * F.col("tokens") - 1e-9).cast("int")
    words = F.filter("marks", lambda m: m["word"])
    enough = F.get(F.sort_array(F.transform(words, lambda m: m["have"]), asc=False), least - 1)
    shape = let(enough, lambda e: F.aggregate("marks", F.lit(0).cast("long"), lambda a, m: a.bitwiseXOR(F.when(m["have"] >= e, m["code"]).otherwise(F.lit(0)))))
    named = marks.filter(F.size(words) >= least).select("hash", F.xxhash64("leaf", shape).alias("template"))
    placed = cut(seen.join(named, "hash", "left").select("doc_id", "content", "line", "tokens", F.coalesce("template", "hash").alias("template")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "line")
    by_document = placed.groupBy("template", "content").agg(F.min(order).alias("first"), F.max("tokens").alias("tokens"))
    recurring = by_document.groupBy("template").agg(F.count("*").alias("docs"), F.min("first").alias("first"), F.max("tokens").alias("tokens")).filter(
        F.col("docs") >= needed(F.col("tokens"), min_docs, long_tokens)
    )
    return placed.join(recurring.select("template", "first"), "template").filter((F.col("content") != F.col("first.content")) | (F.col("line") != F.col("first.line"))).select("content", "line")


def drop_recurring_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns; text without the dropped lines, n_chars (where there is one) its new length, and n_lines, n_dropped.

    n_lines counts lines with a word, before dropping. Null texts stay null
    with counts of 0. Rows that are equal in doc_id and text are one
    document: their lines do not recur for their sake, and they get the same
    text. Tables may be empty and carry any other columns.
    """
    keyed = docs.withColumn("_content", row_hash("doc_id", "text"))
    gone = recurring_lines(keyed.select("doc_id", F.col("_content").alias("content"), "text"), **options)
    lists = gone.groupBy(F.col("content").alias("_content")).agg(F.sort_array(F.collect_set("line")).alias("_gone"))
    joined = keyed.join(lists, "_content", "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<bigint>")))
    rest = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i.cast("long")))
    kept = F.when(F.size("_gone") == 0, F.col("text")).otherwise(F.array_join(rest, "\n"))
    lines = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS.decode(), "")) > 0)), F.lit(0))
    out = joined.withColumns({"_kept": kept, "n_lines": F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long"), "n_dropped": F.size("_gone").cast("long")})
    out = out.withColumn("text", F.col("_kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, "n_lines", "n_dropped")
