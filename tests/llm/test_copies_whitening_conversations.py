"""Exact copies, whitening and conversation repair against plain versions, with nulls, ties, repeats and extremes."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import FOLDER, awkward
from pyspark.sql import functions as F

from rankloom.llm import conversations, exactcopies, whitening
from rankloom.llm.common import read
from rankloom.llm.queries import CATALOG


def rows(df):
    return [r.asDict() for r in df.collect()]


def sort_key(row):
    return sorted((str(k), str(v)) for k, v in row.items())


# ---- 11: exact copies ------------------------------------------------------------
def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_copies(docs):
    groups = defaultdict(list)
    for r in docs:
        groups[normal(r["text"])].append(r["doc_id"])
    out, done = [], set()
    for r in docs:
        content = normal(r["text"])
        ids = [i for i in groups[content] if i is not None]
        keep = min(ids) if ids else None
        first = r["doc_id"] == keep and content not in done
        if first:
            done.add(content)
        out.append({"doc_id": r["doc_id"], "keep_id": keep, "group_size": len(groups[content]), "kept": first, "digest": hashlib.sha256(content.encode()).hexdigest()})
    return out


COPIES = ["a b", "a  b", "a\tb", " a b", "a b ", "a\xa0b", "same"] + ["copy of  many"] * 40 + [None, "", "", " "]


@pytest.mark.parametrize("salts", [None, 1, 7])
def test_copies_equal_plain_version(spark, salts):
    docs = awkward(spark, COPIES).repartition(5)
    got = rows(exactcopies.exact_copies(docs, salts=salts))
    assert sorted(got, key=sort_key) == sorted(plain_copies(rows(docs)), key=sort_key)


def test_contents_of_one_digest_stay_apart(spark):
    docs = awkward(spark, COPIES)
    one_letter = lambda content: F.substring(exactcopies.sha256_hex(content), 1, 1)
    got = rows(exactcopies.exact_copies(docs, digest=one_letter))
    expected = [r | {"digest": r["digest"][0]} for r in plain_copies(rows(docs))]
    assert sorted(got, key=sort_key) == sorted(expected, key=sort_key)
    kept = rows(exactcopies.drop_copies(docs, digest=one_letter))
    assert sorted(normal(r["text"]) for r in kept) == sorted({normal(r["text"]) for r in rows(docs)})


def test_rows_that_stay_keep_their_columns(spark):
    docs = awkward(spark, COPIES)
    kept = exactcopies.drop_copies(docs)
    assert kept.columns == docs.columns
    whole = {str(r) for r in rows(docs)}
    assert all(str(r) in whole for r in rows(kept)) and len({normal(r["text"]) for r in rows(kept)}) == kept.count()
    assert exactcopies.exact_copies(docs.limit(0)).count() == 0 and exactcopies.drop_copies(docs.limit(0)).count() == 0


# ---- 12: whitening ---------------------------------------------------------------
def plain_whitening(vectors, k=8):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    y = (x * n - sums).astype(float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1][:, :k]
    return ((x * n - sums) ** 2).sum(axis=1), values / values.sum(), y @ axes / np.sqrt(values[:k]), n


def vectors(spark, size, seed=3, d=6):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(size, d)) * np.arange(1, d + 1) * 0.1
    data = [(k, [float(np.float32(c)) for c in v], "x", 1, 2) for k, v in enumerate(base)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label string, n int, component int")


@pytest.mark.parametrize("panel_rows", [whitening.PANEL_ROWS, 64])
def test_whitening_equals_plain_version(spark, panel_rows, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 16 * 48)
    table = vectors(spark, 150)
    bad = [(900, None, "x", 1, 2), (901, [None, 1.0], "x", 1, 2), (902, [float("nan")] * 6, "x", 1, 2), (903, [float("inf")] * 6, "x", 1, 2), (904, [], "x", 1, 2), (905, [0.5] * 4, "x", 1, 2), (906, [3e38] * 6, "x", 1, 2)]
    again = table.filter("vec_id = 7").withColumn("vec_id", F.lit(None).cast("long"))
    both = table.unionByName(spark.createDataFrame(bad, table.schema)).unionByName(again)
    got = rows(whitening.whitened(both, panel_rows=panel_rows))
    used = [r["embedding"] for r in rows(table)] + [r["embedding"] for r in rows(again)]
    deviation, explained, coordinates, n = plain_whitening(used)
    ids = [*range(150), None]
    assert len(got) == n * 6 and {r["n"] for r in got} == {n}
    found = np.full((n, 6), np.nan)
    for r in got:
        at = ids.index(r["vec_id"])
        found[at, r["component"] - 1] = r["whitened"]
        assert int(r["deviation"]) == deviation[at] and r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] <= 1e-9
    signs = np.sign((found * coordinates[:, :6]).sum(axis=0))
    assert np.abs(found - coordinates[:, :6] * signs).max() < 1e-8


def test_whitening_without_variance_or_rows(spark):
    table = vectors(spark, 20)
    assert whitening.whitened(table.limit(0)).count() == 0
    flat = table.withColumn("embedding", F.expr("transform(embedding, (c, i) -> if(i = 0, c, cast(0.25 as float)))"))
    got = rows(whitening.whitened(flat))
    assert {r["component"] for r in got if r["whitened"] is None} == {2, 3, 4, 5, 6} and all(r["identity_error"] < 1e-9 for r in got)
    one = rows(whitening.whitened(table.filter("vec_id = 3")))
    assert len(one) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in one)


# ---- 13: conversations -----------------------------------------------------------
def faults(turns):
    out, seen = [], set()
    for _, role, text in turns:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(turns):
    """Cheapest, then ASCII-least edits by a search over whole strings of edits."""
    found = faults(turns)
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, built = heapq.heappop(heap)
        initials = "".join(role[:1] or "-" for role, _ in built)
        if not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        if at == len(turns) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in built)
        if (at, audit) in done or len(built) > len(turns) + 3:
            continue
        done.add((at, audit))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, (*built, (role, ""))))
        if at == len(turns):
            continue
        _, role, text = turns[at]
        held = 3 * (found[at] == "truncated")
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, built))
        if found[at] not in ("blank", "duplicate"):
            heapq.heappush(heap, (cost + held, audit + "K", at + 1, (*built, (role, text))))
            for new in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3 + held, audit + "R", at + 1, (*built, (new, text))))
    raise AssertionError


def plain_row(conv_id, turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    found, numbers = faults(turns), [t for t, _, _ in turns if t is not None]
    initials = [role[:1] for _, role, _ in turns]
    cost, audit, text = plain_repair(turns)
    return {
        "conv_id": conv_id, "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        **{f: found.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def drawn(seed, conversations_, most):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "why", "so?  ", " ", "", "Même.\n", "x" * 9000]
    out = []
    for c in range(conversations_):
        for _ in range(draw.randint(1, most)):
            out.append((None if c == 0 else c, draw.choice([None, 0, 1, 2, 3, 5, 9]), draw.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), draw.choice(texts), c > 3 and draw.random() < 0.15, "x", "y"))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, key string, part string"


@pytest.mark.parametrize("part_rows", [1, 3, conversations.PART_ROWS])
def test_repairs_equal_plain_search(spark, part_rows):
    data = drawn(part_rows, 60, 7) + [(999, 4, "user", "Gone.", True, "x", "y")]
    table = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {r["conv_id"]: r for r in rows(conversations.repairs(table, part_rows))}
    turns = defaultdict(list)
    for c, turn, role, text, gone, *_ in data:
        turns[c] += [] if gone else [(turn, role, text)]
    assert set(got) == set(turns)
    for c, own in turns.items():
        assert got[c] == plain_row(c, own), own
    assert got[999] == {"conv_id": 999, **dict.fromkeys(conversations.COUNTS, 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}

    found = conversations.repairs(table, part_rows)
    built = defaultdict(list)
    for r in sorted(rows(conversations.repaired_rows(table, found)), key=lambda r: r["position"]):
        built[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for c in turns:
        assert hashlib.sha256("\n".join(built[c]).encode()).hexdigest() == got[c]["repaired_sha256"]


def test_a_long_conversation_goes_through_parts(spark):
    table = spark.range(6000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('text ', id, '.') as text", "false as gone")
    got, = rows(conversations.repairs(table, 500))
    whole, = rows(conversations.repairs(table))
    assert got == whole and got["cost"] == 3 * 2000 and re.fullmatch("[KIRD]+", got["audit"]) and len(re.sub("I", "", got["audit"])) == 6000


def test_damage_follows_the_draw(spark):
    table = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"Turn {t}. Said!") for c in range(20) for t in range(6)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in rows(conversations.damaged(table)):
        got[(r["conv_id"], r["turn"])].append((r["role"], r["text"], r["gone"]))
    assert len(got) == 121
    for (c, t), found in got.items():
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" ", " ") if c is None else ("assistant" if t % 2 else "user", f"Turn {t}. Said!")
        text = "" if draw < 2 else re.sub("[.!?]", "", text) if draw == 2 else text
        assert found == [("user" if draw == 4 else role, text, draw == 0)] * (2 if draw == 3 else 1)
    assert conversations.repairs(conversations.damaged(table.limit(0))).count() == 0


def test_registered_queries(spark):
    found = rows(CATALOG.queries["op13_conversation_repair"](spark, FOLDER))
    turns = defaultdict(list)
    for r in rows(conversations.damaged(read(spark, FOLDER, "conversations"))):
        turns[r["conv_id"]] += [] if r["gone"] else [(r["turn"], r["role"], r["text"])]
    assert sorted(found, key=sort_key) == sorted((plain_row(c, own) for c, own in turns.items()), key=sort_key)
    docs = rows(read(spark, FOLDER, "documents"))
    got = [{("digest" if k == "text_sha256" else k): v for k, v in r.items()} for r in rows(CATALOG.queries["op11_exact_copies"](spark, FOLDER))]
    assert sorted(got, key=sort_key) == sorted(plain_copies(docs), key=sort_key)
    table = rows(read(spark, FOLDER, "embeddings"))
    deviation, explained, coordinates, n = plain_whitening([r["embedding"] for r in table])
    at = {r["vec_id"]: k for k, r in enumerate(table)}
    result = rows(CATALOG.queries["op12_block_whitening"](spark, FOLDER))
    assert len(result) == 8 * n and all(abs(abs(r["whitened"]) - abs(coordinates[at[r["vec_id"]], r["component"] - 1])) < 1e-6 and r["deviation"] == deviation[at[r["vec_id"]]] for r in result)
