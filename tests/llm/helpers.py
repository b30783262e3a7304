"""Small tables with every awkward case, and plain versions of what the operators count."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, cls string, content string, size string"
FOLDER = "/root/testdata/sf0.001"


def awkward(spark, texts=(), **more):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, clashing extra columns, then ``texts``."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "no id at all here", None, "b", 17), (5, "same row twice in this table", "en", "b", 28), (5, "same row twice in this table", "en", "b", 28),
        (6, "word " * 30_000, "en", None, 150_000), (7, "x" * 200_000, "de", "c", 200_000), (8, "日本語 ▁ \x0b ☃ ñandú", "es", "c", 17),
    ]
    rows += [(100 + k, t, "en", "abc"[k % 3], len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame([(*r, 9, "x", "y", "z") for r in rows], SCHEMA)


def prose(seed: int, words: int, vocabulary: int = 500) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(words))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, width=5):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))
