"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece crosses: between two characters that no
run of up to four characters of any piece joins. The distinct units are
exploded into substrings of bounded length, equi-joined to the piece table and
grouped again: one row per unit with its edges (start, stop, piece). A higher-
order aggregate folds the edges into the unit's segmentation. Single characters
are edges of their own; they need no join and get their ids when texts are
spelt.

The fold is the merge order of byte-pair models and not a best path: pieces of
such a model carry ranks, not log probabilities, and the path with the best
sum differs from what the model means. Each step applies the best ranked edge
that joins two neighbouring segments, the leftmost on ties, until none is
left.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import let, limit_batches, partitions, row_hash

SPACE = "▁"
LONGEST_UNIT = 60
_BUCKET_CHARS = 32 << 20
_GROUP_CHARS = 4 << 20
_GRAM_BITS = 24


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, tuple[int, float]], list[str], list[int], int]:
    """Normal pieces with id and score, all pieces, the ids of the 256 bytes, the id of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(names))]
    known = {p: (i, model.get_score(i)) for i, p in enumerate(names) if not special[i]}
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in known):
        raise ValueError("pieces that cross spaces or lines are not supported")
    return known, names, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], model.unk_id()


def prepared(text: str) -> str:
    """The text as the model sees it: a space in front, spaces as signs; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Cutter:
    """Cuts prepared texts into units that no piece of the vocabulary crosses.

    A place is crossed if the characters around it are a piece of two or three
    characters or part of a run of four that some piece has. Runs are looked up
    by hash; two runs that share one can only join units, never cut a piece.
    """

    def __init__(self, pieces) -> None:
        self.number = np.zeros(0x110000, np.uint32)
        letters = sorted({c for p in pieces for c in p})
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1, dtype=np.uint32)
        self.space = self.number[ord(SPACE)] or np.uint32(1 << 30)
        self.grams = {}
        for size in (2, 3, 4):
            found = {p[i : i + size] for p in pieces if len(p) == size or size == 4 < len(p) for i in range(len(p) - size + 1)}
            table = np.zeros(1 << _GRAM_BITS, bool)
            if found:
                table[self._hashes(self.number[np.array([[ord(c) for c in g] for g in sorted(found)], np.int64)].T)] = True
            self.grams[size] = table

    @staticmethod
    def _hashes(columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint32)
        for column in columns:
            total = (total ^ column) * np.uint32(0x9E3779B1)
            total ^= total >> np.uint32(15)
        return total >> np.uint32(32 - _GRAM_BITS)

    def starts(self, whole: str, first: np.ndarray | None = None) -> np.ndarray:
        """Where units begin in a text that is not empty; at ``first`` in any case."""
        codes = self.number[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = len(codes)
        crossed = np.zeros(size, bool)  # at k: a piece may cover characters k - 1 and k
        for width, table in self.grams.items():
            count = size - width + 1
            if count <= 0:
                continue
            hit = table[self._hashes([codes[k : k + count] for k in range(width)])]
            for k in range(1, width):
                crossed[k : k + count] |= hit
        # spaces stand at the beginning of pieces only: a space after anything else begins a unit, whatever the hashes say
        space = codes == self.space
        crossed[1:] &= space[:-1] | ~space[1:]
        if first is not None:
            crossed[first] = False
        return np.flatnonzero(~crossed)

    def units(self, whole: str, first: np.ndarray | None = None):
        """Units of a prepared text as an Arrow array over its bytes, where they begin, and their characters.

        ``first`` are places where a unit begins in any case.
        """
        import pyarrow as pa

        if not whole:
            return pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
        starts = self.starts(whole, first)
        data = whole.encode()
        heads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # bytes that begin a character
        offsets = np.append(heads[starts], len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), starts, np.diff(np.append(starts, len(whole)))


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    return Cutter(vocabulary(path)[0])


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    known = vocabulary(path)[0]
    return spark.createDataFrame([(p, i, -s) for p, (i, s) in known.items()], "piece string, id int, rank double")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``words`` (distinct ``word``, ``some``) with edges: array of (rank, start, stop, id) of two characters or more, best rank first.

    The piece table is a vocabulary, so its broadcast is bounded by it.
    """
    size = F.length("word")
    # a span of no length brings every unit back, also one without edges
    starts = words.withColumn("start", F.explode(F.sequence(F.lit(-1), F.greatest(size - 2, F.lit(-1)))))
    stops = F.when(F.col("start") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.col("start") + 2, F.greatest(F.col("start") + 2, F.least(size, F.col("start") + longest))))
    spans = starts.withColumn("stop", F.explode(stops)).withColumn("piece", F.when(F.col("start") >= 0, F.substring("word", F.col("start") + 1, F.col("stop") - F.col("start"))))
    found = spans.join(F.broadcast(pieces), "piece", "left").filter(F.col("id").isNotNull() | (F.col("start") < 0))
    return found.groupBy("word").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("rank", "start", "stop", "id")))).alias("edges"), F.first("some").alias("some"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def merged(edges: Column, size: Column) -> Column:
    """Bits of the boundaries that are left after all merges; bit k stands before character k.

    An edge can be applied if both its ends are boundaries and exactly one
    boundary is left inside it.
    """
    masks = F.transform(edges, lambda e: F.struct((_bit(e["start"]) + _bit(e["stop"])).alias("ends"), (_bit(e["stop"]) - _bit(e["start"] + 1)).alias("inside")))

    def fold(masks: Column) -> Column:
        def step(bits: Column, _: Column) -> Column:
            fits = F.filter(masks, lambda m: (bits.bitwiseAND(m["ends"]) == m["ends"]) & (F.bit_count(bits.bitwiseAND(m["inside"])) == 1))
            return bits.bitwiseAND(F.bitwise_not(F.coalesce(F.get(fits, F.lit(0))["inside"], F.lit(0).cast("long"))))

        every = _bit(size + 1) - 1
        # no merge is left after as many steps as there are edges or inner boundaries
        return F.when(F.size(masks) == 0, every).otherwise(F.aggregate(F.sequence(F.lit(1), F.least(F.size(masks), F.greatest(size - 1, F.lit(1)))), every, step))

    return let(masks, fold)


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """``words`` (distinct ``word``, and ``some`` number that stays) with codes: ids of their pieces in order, a single character as -1 less its code point."""
    known = vocabulary(path)[0]
    latticed = lattice(words, piece_table(words.sparkSession, path), max(map(len, known)))
    cuts = let(merged(F.col("edges"), F.length("word")), lambda bits: F.filter(F.sequence(F.lit(0), F.length("word")), lambda k: bits.bitwiseAND(_bit(k)) != 0))

    def segment(k: Column, stop: Column) -> Column:
        single = -F.lit(1) - F.ascii(F.substring("word", k + 1, F.lit(1)))
        return F.when(stop - k == 1, single).otherwise(F.get(F.filter("edges", lambda e: (e["start"] == k) & (e["stop"] == stop)), F.lit(0))["id"])

    codes = let(cuts, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda k, i: segment(k, F.get(c, i + 1))))
    return latticed.select("word", "some", codes.alias("codes"))


def merge_unit(word: str, known: dict[str, tuple[int, float]], byte_ids: list[int]) -> list[int]:
    """Ids of one unit by a heap of merges: for units too long for the bits of the fold."""
    parts: list[str | None] = list(word)
    before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    waiting: list[tuple] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and (found := known.get(parts[i] + parts[j])):
            heapq.heappush(waiting, (-found[1], i, j, parts[i] + parts[j]))

    for i in range(len(parts)):
        offer(i)
    while waiting:
        _, i, j, text = heapq.heappop(waiting)
        if parts[i] is None or after[i] != j or parts[i] + parts[j] != text:
            continue
        parts[i], parts[j], after[i] = text, None, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    out: list[int] = []
    for part in parts:
        if part is not None:
            out += [known[part][0]] if part in known else [byte_ids[b] for b in part.encode()]
    return out


@lru_cache(maxsize=2)
def _spelling(path: str) -> list[bytes]:
    """What every id stands for, as UTF-8 bytes."""
    _, names, byte_ids, _ = vocabulary(path)
    of_byte = {i: bytes([b]) for b, i in enumerate(byte_ids)}
    return [of_byte[i] if i in of_byte else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]


def decode_ids(ids: list[int], path: str) -> str:
    """Text of piece ids; the dummy space in front is taken off."""
    return _without_dummy(b"".join(map(_spelling(path).__getitem__, ids))).decode("utf-8", "replace")


def _without_dummy(data: bytes) -> bytes:
    return data[1:] if data[:1] == b" " else data


@lru_cache(maxsize=2)
def _spelling_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids in one array, where each id's begin and how many they are."""
    spelt = _spelling(path)
    sizes = np.array([len(s) for s in spelt], np.int64)
    return np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode_many(rows: list[np.ndarray], path: str) -> list[bytes]:
    """UTF-8 of many rows of ids at once, as ``decode_ids`` gives it."""
    table, begins, sizes = _spelling_table(path)
    ids = np.concatenate(rows) if rows else np.empty(0, np.int32)
    counts = sizes[ids]
    ends = np.cumsum(counts)
    source = np.repeat(begins[ids] - (ends - counts), counts)
    source += np.arange(len(source))
    data = table[source].tobytes()
    bounds = np.append(0, ends)[np.cumsum([0, *map(len, rows)])].tolist()
    return [_without_dummy(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class _Speller:
    """Ids of the units of one bucket: one flat array and where each unit's ids stand in it."""

    def __init__(self, words, codes: np.ndarray, offsets: np.ndarray, path: str) -> None:
        self.path, self.words = path, words
        self.known, _, self.byte_ids, _ = vocabulary(path)
        single = codes < 0
        sizes = np.ones(len(codes), np.int64)
        ids = codes.astype(np.int32)
        rest = []
        for code in np.unique(codes[single]).tolist():
            found = self.known.get(chr(-1 - code))
            if found:
                ids[codes == code] = found[0]
            else:  # a character without a piece becomes its bytes
                spelt = [self.byte_ids[b] for b in chr(-1 - code).encode("utf-8", "surrogatepass")]
                sizes[codes == code] = len(spelt)
                rest.append((code, spelt))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = np.repeat(ids, sizes)
        for code, spelt in rest:
            at = ends[:-1][codes == code]
            for k, i in enumerate(spelt):
                self.flat[at + k] = i
        self.offsets = ends[offsets]
        self.sizes = np.append(np.diff(self.offsets), 0)  # the last one stands for units that were not asked for
        self.more: dict[str, np.ndarray] = {}

    def _long(self, unit: str) -> np.ndarray:
        if unit not in self.more:
            self.more[unit] = np.array(merge_unit(unit, self.known, self.byte_ids), np.int32)
        return self.more[unit]

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; texts are cut together, each begins a unit."""
        import pyarrow.compute as pc

        whole = [prepared(t) for t in texts]
        ends = np.cumsum([len(t) for t in whole])
        firsts = np.concatenate([[0], ends[:-1]])
        joined = "".join(whole)
        units, starts, _ = cutter(self.path).units(joined, firsts[firsts < ends])
        places = pc.fill_null(pc.index_in(units, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        long = np.flatnonzero(places < 0).tolist()
        sizes = self.sizes[places]
        for k in long:
            sizes[k] = len(self._long(units[k].as_py()))
        stops = np.cumsum(sizes)
        befores = stops - sizes
        source = np.repeat(self.offsets[places] - befores, sizes)
        source += np.arange(len(source))
        out = self.flat.take(source, mode="clip") if len(self.flat) else np.zeros(len(source), np.int32)
        for k in long:
            out[befores[k] : stops[k]] = self._long(units[k].as_py())
        # units of a text are those that begin inside it
        bounds = np.concatenate([[0], stops])[np.concatenate([np.searchsorted(starts, firsts), [len(units)]])]
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of about ``_GROUP_CHARS`` characters together."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= _GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, ids, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip.

    Null and empty texts have no pieces. round_trip: decoding gives the text
    back (not so for texts that hold the space sign itself). Equal rows get
    equal rows; extra columns are ignored.

    Documents are dealt into buckets of a bounded number of characters. Each
    bucket asks once for each of its distinct units; units of all buckets are
    encoded together, and the codes go back to the buckets that asked. Longer
    units than the fold's bits are merged in the bucket itself.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # fewer and larger buckets ask for less; small tables still have one for every core
    wanted = max(min(partitions(spark), spark.sparkContext.defaultParallelism), int(chars // _BUCKET_CHARS) + 1)
    bucketed = docs.select(F.pmod(row_hash("doc_id", "text"), F.lit(wanted)).cast("int").alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = bucketed.mapInArrow(_pack, "bucket int, packet binary").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def asked(bucket, found):
            words = pc.unique(pa.concat_arrays(found)) if found else []
            for start in range(0, len(words), 1 << 16):
                part = words[start : start + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket, np.int32)), part], ["bucket", "word"])

        cut, now, found = cutter(path).units, None, []
        for batch in batches:
            for bucket, packet in zip(batch.column("bucket").to_pylist(), batch.column("packet"), strict=True):
                if bucket != now:
                    yield from asked(now, found)
                    now, found = bucket, []
                for group in _groups(_unpack(packet.as_py()).column("text").to_pylist()):
                    units, _, sizes = cut("".join(map(prepared, group)))
                    found.append(pc.unique(units.filter(pa.array(sizes <= LONGEST_UNIT))))
        yield from asked(now, found)

    # asks are placed by unit once; the distinct units and the way back to the buckets read the same exchange,
    # which they would not if the distinct units could do without the bucket
    asks = dealt.mapInArrow(ask, "bucket int, word string").repartition(partitions(spark), "word")
    codes = encoded_words(asks.groupBy("word").agg(F.max("bucket").alias("some")), path)
    answers = asks.join(codes.filter("some is not null").hint("shuffle_hash"), "word").drop("some")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def spell(packets, words):
        import pyarrow as pa

        listed = words.column("codes").combine_chunks()
        asked = words.column("word").combine_chunks().cast(pa.string())
        speller = _Speller(asked, listed.values.to_numpy(zero_copy_only=False), listed.offsets.to_numpy(), path) if words.num_rows else _Speller(asked, np.empty(0, np.int32), np.zeros(1, np.int32), path)
        tables = []
        for packet in packets.column("packet"):
            texts = _unpack(packet.as_py())
            rows, crcs, trips = [], [], []
            for group in _groups(texts.column("text").to_pylist()):
                spelt = speller.texts(group)
                rows += spelt
                crcs += [zlib.crc32(ids.astype("<u4").tobytes()) for ids in spelt]
                trips += [back == text.encode() for text, back in zip(group, decode_many(spelt, path), strict=True)]
            sizes = np.array([len(r) for r in rows], np.int64)
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
            tables.append(pa.Table.from_arrays(
                [texts.column("doc_id"), lists, pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(trips, pa.bool_())], ["doc_id", "ids", "n_pieces", "ids_crc32", "round_trip"],
            ))
        return pa.concat_tables(tables)

    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(spell, f"doc_id {kind}, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean")


def _pack(batches: Iterator) -> Iterator:
    """Documents of one bucket of a batch as one compressed packet, which is less to shuffle than its rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        order = pc.sort_indices(batch.column("bucket"))
        rows = batch.take(order)
        buckets = np.array(rows.column("bucket"))
        starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.empty(0, np.int64)
        packets = []
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)], strict=True) if len(starts) else []:
            sink = pa.BufferOutputStream()
            part = rows.slice(start, stop - start).select(["doc_id", "text"])
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
                out.write_batch(part)
            packets.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(buckets[starts].astype(np.int32)), pa.array(packets, pa.binary())], ["bucket", "packet"])


def _unpack(packet: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(packet).read_all()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with its columns and text, decoded from ids; null ids give null."""

    def back(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if i is None else decode_ids(i, path) for i in batch.column("ids").to_pylist()], pa.string())], [*batch.schema.names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(back, f"{kinds}, text string")
