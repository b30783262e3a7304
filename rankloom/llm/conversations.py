"""Repair of conversation structure: cheapest edits that make roles an optional system turn and user-assistant pairs.

Rows are repartitioned by conversation and sorted by turn within partitions
(Spark's sort, which spills). ``mapInPandas`` reads them once and carries, from
one Arrow batch to the next, the state of a dynamic program with four places:
nothing yet (0), after system (S), after user (U), after assistant (A). Each
place keeps its least cost, the rank of its edits in ASCII order, and a running
SHA-256 of its repaired text, so no text is ever kept. One byte per row and
place names the best edit. These back pointers leave the task as rows of
``part_rows`` turns each, which Spark writes to the shared folder. A
conversation of more than one such part is traced back by a second stream over
its parts, last part first. So neither step's memory grows with a conversation.

Why ranks suffice for the ASCII-least edits: after a row's edit every place's
string has as many row edits as there were rows and ends in one. None is then a
prefix of another, so two strings stay in order whatever follows.

Whether a row's role and text stood earlier is found by grouping digests over
all tasks, not by a set of rows seen. Rows of one turn are ordered by role and
text.

Defined cases: null conversation ids form one conversation; a null turn comes
first; null roles and texts are one space, so such a text is blank; an empty
table gives an empty result; equal rows are rows of their own. Further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BLANK_CLASS, cut, limit_batches, partitions

PART_ROWS = 1 << 16
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3

# places of the program and where roles lead
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_BY_ROLE = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_EDITS = (DELETE, KEEP, REROLE)
_NONE = 255
_INSERTS = 2

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SUMMARY = ", ".join(f"{c} long" for c in COUNTS)
_STREAM = "key string, conv_id {id}, part long, back binary, ends int, {summary}, audit string, repaired_sha256 string"


def conversation_key(conv_id: Column) -> Column:
    """A text that stands for the id, null told apart from any value."""
    return F.when(conv_id.isNull(), "n").otherwise(F.concat(F.lit("c"), conv_id.cast("string")))


def described(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with key and the flags the program reads; ``gone`` rows only name their conversation."""
    flagged = rows.select(
        conversation_key(F.col("conv_id")).alias("key"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone",
    )
    core = F.regexp_replace("text", f"{BLANK_CLASS}+$", "")
    flagged = flagged.withColumns({
        "blank": F.length(core) == 0,
        "truncated": ~F.substring(core, -1, 1).isin(".", "!", "?"),
        "same": F.unhex(F.sha2(F.concat_ws("\x00", "key", F.length("role").cast("string"), "role", "text").cast("binary"), 256)),
    })
    seen = F.min(F.struct(F.col("turn").isNotNull().alias("late"), "turn"))
    recurring = flagged.filter("not gone and not blank").groupBy("same").agg(F.count(F.lit(1)).alias("times"), seen.alias("first")).filter("times > 1").select("same", "first")
    here = F.struct(F.col("turn").isNotNull().alias("late"), "turn")
    return flagged.join(recurring, "same", "left").withColumn("earlier", F.coalesce(F.col("first") < here, F.lit(False))).drop("first")


class _Conversation:
    """The program's state over one conversation, fed row by row."""

    def __init__(self, key, conv_id):
        self.key, self.conv_id, self.part, self.back = key, conv_id, 0, bytearray()
        self.paths = {_START: (0, 0, hashlib.sha256())}
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.last_initial = self.last_same = None
        self.turns = 0

    def feed(self, turn, role, text, blank, truncated, same, earlier) -> None:
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        # equal rows of one turn are neighbours: the second one stood earlier too
        again = earlier or (turn, same) == self.last_same
        self.last_initial, self.last_same = initial, (turn, same)
        fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
        if fault:
            self.counts[fault] += 1
        self._step(initial, role, text, fault)

    def _step(self, initial, role, text, fault) -> None:
        best = {}
        held = TRUNCATED_COST if fault == "truncated" else 0
        must_go = fault in ("blank", "duplicate")
        by_role = _BY_ROLE.get(initial, {})
        for place, (cost, rank, _) in self.paths.items():
            at = place
            for inserts in range(_INSERTS + 1):  # more of them only come back to places already reached
                letters = INSERT * inserts
                ways = [(DELETE, at, COST[DELETE])]
                if not must_go:
                    if at in by_role:
                        ways.append((KEEP, by_role[at], held))
                    ways.append((REROLE, _NEXT[at], COST[REROLE] + held))
                for edit, to, more in ways:
                    found = (cost + more, rank, letters + edit, place)
                    if to not in best or found < best[to]:
                        best[to] = found
                at, cost = _NEXT[at], cost + COST[INSERT]
        ranks = {found[1:3]: rank for rank, found in enumerate(sorted(best.values(), key=lambda f: f[1:3]))}
        paths, back = {}, bytearray((_NONE,) * 4)
        body = None
        for to, (cost, rank, letters, place) in best.items():
            digest, edit = self.paths[place][2], letters[-1]
            if len(letters) > 1 or edit != DELETE:
                digest, at = digest.copy(), place
                for _ in letters[:-1]:
                    digest.update(_line(at, _ROLE[_NEXT[at]] + ":"))
                    at = _NEXT[at]
                if edit != DELETE:
                    body = f":{text}" if body is None else body
                    digest.update(_line(at, (role if edit == KEEP else _ROLE[_NEXT[at]]) + body))
            paths[to] = (cost, ranks[(rank, letters)], digest)
            back[to] = place << 4 | len(letters) - 1 << 2 | _EDITS.index(edit)
        self.paths = paths
        self.back += back

    def spill(self) -> dict:
        """The back pointers so far, as a row of their own."""
        row = self._row(back=zlib.compress(bytes(self.back), 1))
        self.part, self.back = self.part + 1, bytearray()
        return row

    def close(self) -> dict:
        found = []
        for place, (cost, rank, digest) in self.paths.items():
            at, inserts = place, 0
            digest = digest.copy()
            while at not in (_START, _ASSISTANT):
                digest.update(_line(at, _ROLE[_NEXT[at]] + ":"))
                at, inserts = _NEXT[at], inserts + 1
            found.append((cost + COST[INSERT] * inserts, rank, inserts, place, digest))
        cost, _, inserts, place, digest = min(found, key=lambda f: f[:2])
        if self.turns:
            self.counts["gaps"] = self.last_turn - self.first_turn + 1 - self.turns
        self.counts["cost"] = cost
        more = {"repaired_sha256": digest.hexdigest(), "ends": place << 2 | inserts, **self.counts}
        if self.part:
            return self._row(back=zlib.compress(bytes(self.back), 1), **more)
        return self._row(audit=_traced(self.back, place)[0] + INSERT * inserts, **more)

    def _row(self, **values) -> dict:
        return {"key": self.key, "conv_id": self.conv_id, "part": self.part, "back": None, "ends": None, **dict.fromkeys(COUNTS), "audit": None, "repaired_sha256": None, **values}


def _line(place: int, content: str) -> bytes:
    return ("" if place == _START else "\n").encode() + content.encode("utf-8", "surrogatepass")


def _traced(back: bytes, place: int) -> tuple[str, int]:
    """Edits of the rows of one part in order, and the place before its first row, from the place after its last."""
    letters = []
    for at in range(len(back) - 4, -1, -4):
        code = back[at + place]
        letters.append(INSERT * (code >> 2 & 3) + _EDITS[code & 3])
        place = code >> 4
    return "".join(reversed(letters)), place


def _none(value):
    return None if value is None or value != value else value


def _streamed(part_rows: int):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        now = None
        for batch in batches:
            out = []
            # whole numbers with nulls arrive as objects or floats; turns are sent as texts to stay exact
            for key, conv_id, turn, role, text, gone, blank, truncated, same, earlier in batch.itertuples(index=False, name=None):
                if now is None or key != now.key:
                    if now is not None:
                        out.append(now.close())
                    now = _Conversation(key, _none(conv_id))
                if not gone:
                    now.feed(None if turn is None else int(turn), role, text, blank, truncated, same, earlier)
                    if len(now.back) >= 4 * part_rows:
                        out.append(now.spill())
            if out:
                yield pd.DataFrame(out)
        if now is not None:
            yield pd.DataFrame([now.close()])

    return run


def _retraced(batches: Iterator) -> Iterator:
    """Letters of every part; parts of a conversation come last first, the place goes from batch to batch."""
    import pandas as pd

    key = place = None
    for batch in batches:
        out = []
        for k, part, back, ends in batch.itertuples(index=False, name=None):
            tail = ""
            if k != key:
                key, place, tail = k, int(ends) >> 2, INSERT * (int(ends) & 3)
            letters, place = _traced(zlib.decompress(back), place)
            out.append((k, part, letters + tail))
        yield pd.DataFrame(out, columns=["key", "part", "letters"])


def repairs(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): counts of faults, least cost, its edits, digest of the result."""
    spark = rows.sparkSession
    limit_batches(spark)
    kind = dict(rows.dtypes)["conv_id"]
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("gone")]
    sent = ("key", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "gone", "blank", "truncated", "same", "earlier")
    placed = described(rows).repartition(partitions(spark), "key").sortWithinPartitions(*order)
    found = cut(placed.select(*sent).mapInPandas(_streamed(part_rows), _STREAM.format(id="string", summary=_SUMMARY)))

    small = found.filter("audit is not null")
    large = found.filter("audit is null")
    columns = ["key", "conv_id", *COUNTS, "audit", "repaired_sha256"]
    whole = small.select(*columns)
    if not large.isEmpty():
        parts = large.select("key", "part", "back", "ends").repartition(partitions(spark), "key").sortWithinPartitions("key", F.desc("part"))
        letters = parts.mapInPandas(_retraced, "key string, part long, letters string")
        audits = letters.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "letters"))), lambda p: p["letters"]), "").alias("audit"))
        whole = whole.unionByName(large.filter("ends is not null").drop("audit").join(audits, "key").select(*columns))
    return whole.select(F.col("conv_id").cast(kind).alias("conv_id"), *columns[2:])


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, position from 0, role, text, edit (K, R or I); ``found`` is what ``repairs`` gave."""
    spark = rows.sparkSession
    limit_batches(spark)
    kind = dict(rows.dtypes)["conv_id"]
    key, space = conversation_key(F.col("conv_id")), F.lit(" ")
    turns = rows.filter("not gone").select(key.alias("key"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(1).alias("kind"))
    audits = found.select(key.alias("key"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("kind"))
    both = audits.unionByName(turns).repartition(partitions(spark), "key").sortWithinPartitions("key", "kind", F.col("turn").asc_nulls_first(), "role", "text")
    out = both.select("key", "kind", "role", "text").mapInPandas(_applied, "key string, position long, role string, text string, edit string")
    conv_id = F.when(F.col("key") != "n", F.expr("substring(key, 2)")).cast(kind)
    return out.select(conv_id.alias("conv_id"), "position", "role", "text", "edit")


def _applied(batches: Iterator) -> Iterator:
    import pandas as pd

    key, audit, at, place, position = None, "", 0, _START, 0
    out = []

    def put(role, text, edit, to):
        nonlocal place, position
        out.append((key, position, role, text, edit))
        place, position = to, position + 1

    def insert():
        nonlocal at
        while at < len(audit) and audit[at] == INSERT:
            put(_ROLE[_NEXT[place]], "", INSERT, _NEXT[place])
            at += 1

    names = ["key", "position", "role", "text", "edit"]
    for batch in batches:
        for k, kind, role, text in batch.itertuples(index=False, name=None):
            if not kind:
                insert()
                key, audit, at, place, position = k, text, 0, _START, 0
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit == KEEP:
                put(role, text, KEEP, _BY_ROLE[role[:1]][place])
            elif edit == REROLE:
                put(_ROLE[_NEXT[place]], text, REROLE, _NEXT[place])
        yield pd.DataFrame(out, columns=names)
        out = []
    insert()
    if out:
        yield pd.DataFrame(out, columns=names)


# ---- the damage the registered query repairs -----------------------------------
def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with planted faults, drawn by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays as ``gone``, to name its conversation), 1 empties
    its text, 2 takes its sentence ends, 3 repeats it, 4 calls it user.
    """
    space = F.lit(" ")
    plain = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    draw = plain.withColumn("draw", F.crc32(name.cast("binary")) % 20)
    text = F.when(F.col("draw").isin(0, 1), "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1))
    return draw.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")
