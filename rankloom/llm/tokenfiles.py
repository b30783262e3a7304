"""Token ids in binary files of patched frame-of-reference blocks.

A file (little-endian) holds neighbouring documents of the ascending order:

    magic "RLPF", u32 version, u32 ids a block, u64 documents, u64 ids
    documents times i64 doc_id, documents times u8 (1: the id is null), documents times u32 ids of the document
    u64 blocks + 1 byte offsets: where each block starts in the block area
    block area

A block is u32 minimum, u8 width, u16 exceptions; then the differences from
the minimum, ``width`` bits each; then u16 positions and u32 differences of
the exceptions, whose packed value is 0. The width is the bits that a chosen
share of the block's differences fit into.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import cut, limit_batches, partitions, shared_folder

BLOCK = 1024
MAGIC = b"RLPF"
_HEAD = np.dtype([("magic", "S4"), ("version", "<u4"), ("block", "<u4"), ("documents", "<u8"), ("ids", "<u8")])
_BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # the exponent above a half; 0 of 0


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = 0.9) -> tuple[np.ndarray, bytes]:
    """Byte offsets of all blocks and of the end, and the block area."""
    parts, offsets = [], [0]
    for start in range(0, len(ids), block * 256):
        run = ids[start : start + block * 256]
        whole = -(-len(run) // block)
        # the last block is filled up with its last id; readers know the number of ids
        grid = np.concatenate([run, np.full(whole * block - len(run), run[-1], run.dtype)]).reshape(whole, block).astype(np.int64)
        low = grid.min(axis=1)
        apart = grid - low[:, None]
        bits = _bit_lengths(apart)
        widths = np.sort(bits, axis=1)[:, min(block - 1, int(np.ceil(percentile * block)) - 1)]
        packed: dict[int, dict[int, bytes]] = {}
        outside = bits > widths[:, None]
        kept = np.where(outside, 0, apart)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            spread = np.unpackbits(kept[rows].astype("<u4").view(np.uint8), axis=1, bitorder="little").reshape(-1, 32)[:, :width].reshape(len(rows), -1)
            packed[int(width)] = dict(zip(rows.tolist(), (r.tobytes() for r in np.packbits(spread, axis=1, bitorder="little")), strict=True)) if width else dict.fromkeys(rows.tolist(), b"")
        for k in range(whole):
            places = np.flatnonzero(outside[k])
            head = np.array([(low[k], widths[k], len(places))], _BLOCK_HEAD).tobytes()
            piece = head + packed[int(widths[k])][k] + places.astype("<u2").tobytes() + apart[k][places].astype("<u4").tobytes()
            parts.append(piece)
            offsets.append(offsets[-1] + len(piece))
    return np.array(offsets, "<u8"), b"".join(parts)


def unpack_blocks(area: bytes, offsets: np.ndarray, first: int, last: int, block: int = BLOCK) -> np.ndarray:
    """Ids of the blocks first up to before last; the block index finds them without reading others."""
    out = np.empty((last - first, block), np.int64)
    for k in range(first, last):
        at = int(offsets[k])
        head = np.frombuffer(area, _BLOCK_HEAD, 1, at)[0]
        at, width, more = at + _BLOCK_HEAD.itemsize, int(head["width"]), int(head["exceptions"])
        size = -(-block * width // 8)
        row = out[k - first]
        if width:
            bits = np.unpackbits(np.frombuffer(area, np.uint8, size, at), count=block * width, bitorder="little").reshape(block, width)
            wide = np.zeros((block, 32), np.uint8)
            wide[:, :width] = bits
            row[:] = np.packbits(wide, axis=1, bitorder="little").view("<u4")[:, 0]
        else:
            row[:] = 0
        if more:
            row[np.frombuffer(area, "<u2", more, at + size)] = np.frombuffer(area, "<u4", more, at + size + 2 * more)
        row += int(head["low"])
    return out.ravel()


def file_image(doc_ids: list, counts: list[int], ids: np.ndarray, block: int = BLOCK, percentile: float = 0.9) -> bytes:
    offsets, area = pack_blocks(ids, block, percentile) if len(ids) else (np.zeros(1, "<u8"), b"")
    head = np.array([(MAGIC, 1, block, len(doc_ids), len(ids))], _HEAD).tobytes()
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return head + names + np.array(counts, "<u4").tobytes() + offsets.tobytes() + area


class TokenFile:
    """Reads a file image; ``ids`` of any document need only the blocks that it touches."""

    def __init__(self, image: bytes) -> None:
        head = np.frombuffer(image, _HEAD, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a token file")
        n, self.block, self.size = int(head["documents"]), int(head["block"]), int(head["ids"])
        at = _HEAD.itemsize
        named = np.frombuffer(image, "<i8", n, at)
        null = np.frombuffer(image, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(named, null, strict=True)]
        self.counts = np.frombuffer(image, "<u4", n, at + 9 * n).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        at += 13 * n
        blocks = -(-self.size // self.block)
        self.offsets = np.frombuffer(image, "<u8", blocks + 1, at)
        self.area = memoryview(image)[at + 8 * (blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, np.int64)
        first, last = start // self.block, -(-stop // self.block)
        return unpack_blocks(self.area, self.offsets, first, last, self.block)[start - first * self.block : stop - first * self.block]

    def documents(self, about: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the file and ids of every document; neighbouring small ones are unpacked together."""
        k = 0
        while k < len(self.counts):
            start = int(self.ends[k] - self.counts[k])
            stop = max(k + 1, int(np.searchsorted(self.ends, start + about, side="right")))
            found = self.ids(start, int(self.ends[stop - 1]))
            for j in range(k, stop):
                at = int(self.ends[j] - self.counts[j])
                yield self.doc_ids[j], at, found[at - start : at - start + int(self.counts[j])]
            k = stop


# what a file must say for its words to be cut here: lower-cased, then runs of letters, single digits, runs of the rest
_CUT_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_CUT_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
# characters whose lower case, class and composed form are the same in every version of Unicode
_CUT_WORD = "[!-~¡«»¿À-ÖØ-öø-ÿ]+"
_CUT_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_characters() -> list[str]:
    """The character that byte-level files write for every byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _cuts_words(path: str) -> bool:
    """Whether a tokenizers file cuts words as ``_CUT_PIECE`` does and merges every piece by itself."""
    with open(path, encoding="utf-8") as file:
        form = json.load(file)
    plain = form["model"]["type"] == "BPE" and not form["model"].get("dropout")
    return plain and form["normalizer"] == _CUT_NORMALIZER and form["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_CUT_SPLIT, _CUT_BYTES]}


@lru_cache(maxsize=2)
def word_encoder(path: str, most: int = 400_000) -> Callable[[list[bytes]], list[np.ndarray]]:
    """Encoder of UTF-8 texts with a tokenizers file whose tokens never span white space.

    Pieces between white space repeat: each is encoded once and looked up from
    then on, until ``most`` are known; later ones are encoded with the texts
    that hold them. Pieces go to the tokenizer many at a time, kept apart by
    one of its special tokens. Where the file cuts words in a way known here
    (``_cuts_words``), the words of common characters are cut first, and the
    tokenizer's model merges every different piece once. A worker process
    keeps what it learned for its next task.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
    width = np.dtype(kind).itemsize
    apart = next(((i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
    known: dict[bytes, bytes] = {}
    cuts = _cuts_words(path)
    special = "".join({t.content[0] for t in tokenizer.get_added_tokens_decoder().values()})
    cut_here = re.compile(f"(?!.*[{re.escape(special)}]){_CUT_WORD}" if special else _CUT_WORD).fullmatch
    shown = _byte_characters()
    table = {c: "".join(shown[b] for b in chr(c).encode()) for c in (*range(0x21, 0x7F), *range(0xA1, 0x100))}
    merge = tokenizer.model.tokenize

    class Merged(dict):
        """Ids of every piece the model has merged; the first ``most`` stay."""

        def __missing__(self, piece: str) -> bytes:
            ids = np.array([t.id for t in merge(piece.translate(table))], kind).tobytes()
            if len(self) < most:
                self[piece] = ids
            return ids

    ids_of = Merged().__getitem__

    def learn_cut(words: list[bytes]) -> tuple[dict[bytes, bytes], list[bytes]]:
        """Ids of the words that are cut here, and the other words."""
        texts = b"\n".join(words).decode()
        out, others = {}, []
        for word, text, low in zip(words, texts.split("\n"), texts.lower().split("\n"), strict=True):
            if cut_here(text):
                out[word] = b"".join(map(ids_of, _CUT_PIECE.findall(low)))
            else:
                others.append(word)
        return out, others

    def learn(words: list[bytes]) -> dict[bytes, bytes]:
        done, words = learn_cut(words) if cuts and words else ({}, words)
        # a piece that may hold a special token itself goes alone
        alone = [w for w in words if not apart or apart[1][0].encode() in w]
        plain = [w for w in words if apart and apart[1][0].encode() not in w]
        out = {w: np.array(tokenizer.encode(w.decode(), add_special_tokens=False).ids, kind).tobytes() for w in alone}
        groups = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
        for group in groups:
            ids = np.array(tokenizer.encode(apart[1].join(w.decode() for w in group), add_special_tokens=False).ids, kind)
            stops = np.flatnonzero(ids == apart[0]) * width
            data = ids.tobytes()
            out.update(zip(group, (data[a:b] for a, b in zip([0, *(stops + width).tolist()], [*stops.tolist(), len(data)], strict=True)), strict=True))
        return {**out, **done}

    def encode(texts: list[bytes]) -> list[np.ndarray]:
        split = [t.split() for t in texts]  # of bytes: at the six ASCII blanks only
        fresh = learn(list(set().union(*split).difference(known)))
        passing = len(known) + len(fresh) > most
        known.update(fresh)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), kind).astype(np.uint32) for words in split]
        if passing:
            for word in fresh:
                del known[word]
        return out

    return encode


def write_tokens(docs: DataFrame, tokenizer_path: str, *, end_id: int | None = 2, ids_per_file: int = 1 << 20, percentile: float = 0.9, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write ``docs`` (doc_id, text) as token files; returns the folder and the manifest (part, seq, file, n_docs, n_ids).

    Documents go out in ascending doc_id order, null ids first, ties by text:
    ranges of ids are the parts, and every part is cut into files of about
    ``ids_per_file`` ids. A file is written under a name of its own and then
    moved, so a task that runs again leaves the same files. Null texts are
    empty and have the end id only. The folder is a new one inside the shared
    folder unless given.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    target = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(target)
        system.create_dir(root, recursive=True)
        encode = word_encoder(tokenizer_path)
        tail = np.empty(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        names, counts, held, seq = [], [], [], 0

        def flush():
            nonlocal names, counts, held, seq
            image = file_image(names, counts, np.concatenate(held), percentile=percentile)
            name = f"part-{part:06d}-{seq:06d}.tokens"
            own = f"{root}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(own) as out:
                out.write(image)
            system.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_docs": len(names), "n_ids": sum(counts)}])
            names, counts, held, seq = [], [], [], seq + 1
            return row

        total = 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            at = 0
            while at < len(doc_ids):
                group, size = [], 0
                while at + len(group) < len(doc_ids) and (not group or size < 1 << 18):
                    group.append(texts[at + len(group)].as_py())
                    size += len(group[-1])
                for doc_id, ids in zip(doc_ids[at : at + len(group)], encode(group), strict=True):
                    names.append(doc_id)
                    held.append(np.concatenate([ids, tail]))
                    counts.append(len(held[-1]))
                    total += counts[-1]
                    if total >= ids_per_file:
                        yield flush()
                        total = 0
                at += len(group)
        if names:
            yield flush()

    return target, cut(ordered.mapInArrow(write, "part long, seq long, file string, n_docs long, n_ids long"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the token files of a folder: part, seq, doc_id, inside (start in the file), n_tokens, ids_crc32.

    Files come through Spark's binary reader, so any store that Spark reads will do.
    """

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, seq = name.rsplit("/", 1)[-1].split(".")[0].split("-")[1:]
                rows = [(d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in TokenFile(content.as_py()).documents()]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part)] * len(rows)), pa.array([int(seq)] * len(rows)), *[pa.array(c, pa.int64()) for c in columns]],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tokens").load(folder).select("path", "content")
    return files.mapInArrow(decode, "part long, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long")


def file_starts(manifest: DataFrame) -> DataFrame:
    """part, seq, first: ids of all files before each. Sums per part, then parts in order: one row a part meets in one task."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = parts.select("part", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("skip")).join(before, "part").select("part", "seq", (F.col("before") + F.col("skip")).alias("first"))


def token_table(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write ``docs`` as token files, read them back: doc_id, start, n_tokens, ids_crc32. An empty table gives no rows."""
    spark = docs.sparkSession
    folder, manifest = write_tokens(docs, tokenizer_path, **options)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read_tokens(spark, folder).join(file_starts(manifest), ["part", "seq"])
    return found.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
