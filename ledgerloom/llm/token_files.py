"""Token ids of documents as flat binary files with 64-bit document offsets.

A data set is a folder of shards. Shard ``k`` holds three files without headers, all little endian:
``ids-k.bin`` (unsigned 16-bit ids, or 32-bit where the vocabulary needs them), ``offsets-k.bin`` (signed 64-bit,
one per document and one more, counted in ids within the shard) and ``docs-k.bin`` (signed 64-bit document ids).
``index.json`` names the width and, per shard, its documents, ids and base: the number of ids in all shards before
it. Shards are ranges of document ids, so the concatenated shards are the corpus in ascending id order. A reader
maps the files into memory where the folder is local and opens them through pyarrow's file system elsewhere.

Defined cases: a null text is an empty text; null document ids come last, stored as -2**63 and read as null; rows
with the same id stay, ordered by their ids' bytes; an empty table gives an index without shards. Extra columns are
never looked at.
"""

from __future__ import annotations

import codecs
import functools
import json
import operator
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh_dir, ship_package, shuffle_parts, single_thread, store, texts_of

NULL_ID = -(2**63)
#: Characters with the Unicode property White_Space; a token of the pattern below never crosses into a run of them.
SPACES = "\t-\r \x85\xa0  -     　"
#: Fixed value: the pre-tokenizer's pattern of the public byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word with one of these behind it is two pieces.
MARKS = frozenset(".,;:!?")
#: Distinct units whose ids a worker remembers; a full memory is emptied, which costs time and changes nothing.
CACHE = 1_000_000
LONG_UNIT = 64


def byte_alphabet() -> str:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in kept else next(others)) for b in range(256))


@functools.cache
def bpe_encoder(path: str, end_id: int | None) -> Callable[[str], bytes]:
    """Ids of a text as little-endian bytes, by the ``tokenizers`` library.

    Pre-tokens never cross the start of a run of white space, so a text is cut there and each distinct unit is
    encoded once per worker process, which keeps its encoder from task to task; the concatenation equals encoding
    the whole text. A text that holds one of the tokenizer's added tokens literally goes to the tokenizer whole, as these
    are cut out before pre-tokenizing.
    """
    import re

    import regex
    from tokenizers import Tokenizer

    single_thread()
    tokenizer = Tokenizer.from_file(path)
    model, width = tokenizer.model, id_type(tokenizer.get_vocab_size())
    units = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
    pieces, alphabet = regex.compile(PIECES).findall, byte_alphabet()
    end = b"" if end_id is None else np.array([end_id], width).tobytes()
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
    memory: dict[str, bytes] = {}
    code, id_of = "H" if width == "<u2" else "I", operator.attrgetter("id")

    def keep(unit: str, ids: bytes) -> bytes:
        if len(unit) <= LONG_UNIT:
            if len(memory) >= CACHE:
                memory.clear()
            memory[unit] = ids
        return ids

    def piece_ids(piece: str) -> bytes:
        ids = memory.get(piece)
        if ids is None:
            tokens = model.tokenize(codecs.charmap_decode(piece.encode(), "strict", alphabet)[0])
            ids = keep(piece, array(code, map(id_of, tokens)).tobytes())
        return ids

    def unit_ids(unit: str) -> bytes:
        ids = memory.get(unit)
        if ids is None:
            if unit.removeprefix(" ").isalpha():
                return piece_ids(unit)
            if unit[-1] in MARKS and unit[:-1].removeprefix(" ").isalpha():
                ids = keep(unit, piece_ids(unit[:-1]) + piece_ids(unit[-1]))
            else:
                ids = keep(unit, b"".join(map(piece_ids, pieces(unit))))
        return ids

    def encode(text: str) -> bytes:
        for token in added:
            if token in text:
                return np.array(tokenizer.encode(text, add_special_tokens=False).ids, width).tobytes() + end
        found = units(text)
        try:
            return b"".join([memory[u] for u in found]) + end
        except KeyError:
            return b"".join([memory.get(u) or unit_ids(u) for u in found]) + end

    return encode


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 2**16 else "<u4"


class ShardWriter:
    """Writes one shard under temporary names and moves it to its final names when complete."""

    def __init__(self, folder: str, shard: int, width: str):
        self.files, self.base = store(folder)
        self.shard, self.width, self.attempt = shard, np.dtype(width).itemsize, uuid.uuid4().hex
        self.files.create_dir(self.base, recursive=True)
        self.out = {k: self.files.open_output_stream(self.name(k, True)) for k in ("ids", "offsets", "docs")}
        self.docs = self.tokens = 0
        self.out["offsets"].write(np.zeros(1, "<i8").tobytes())

    def name(self, kind: str, temporary: bool = False) -> str:
        return f"{self.base}/{kind}-{self.shard}.bin" + (f".{self.attempt}" if temporary else "")

    def add(self, doc_ids: np.ndarray, parts: list[bytes]) -> None:
        sizes = np.array([len(p) for p in parts], "<i8") // self.width
        self.out["ids"].write(b"".join(parts))
        self.out["offsets"].write((self.tokens + np.cumsum(sizes)).astype("<i8").tobytes())
        self.out["docs"].write(doc_ids.astype("<i8").tobytes())
        self.docs, self.tokens = self.docs + len(parts), self.tokens + int(sizes.sum())

    def close(self) -> dict:
        for kind, stream in self.out.items():
            stream.close()
            try:
                self.files.move(self.name(kind, True), self.name(kind))
            except OSError:  # stores that don't overwrite: an earlier attempt left the same content
                self.files.delete_file(self.name(kind))
                self.files.move(self.name(kind, True), self.name(kind))
        return {"shard": [self.shard], "docs": [self.docs], "tokens": [self.tokens]}


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, shards: int | None = None,
                      doc_id: str = "doc_id", text: str = "text") -> dict:
    """Encode every text and write the data set; returns its index.

    The texts are encoded where they are read; only the packed ids are shuffled, by ranges of the document id whose
    limits are quantiles of that column (``shards`` numbers, the only thing besides shard totals on the driver).
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship_package(spark)
    shards = shards or shuffle_parts(spark)
    width = id_type(Tokenizer.from_file(tokenizer).get_vocab_size())
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    limits = source.agg(F.percentile_approx("doc", [(i + 1) / shards for i in range(shards - 1)] or [0.5], 10_000)).first()[0]
    limits = np.unique(np.array(limits or [], "i8"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe_encoder(tokenizer, end_id)
        for batch in texts_of(batches):
            doc = batch.column(0)
            known = np.array(doc.fill_null(NULL_ID), "i8")
            shard = np.where(np.array(doc.is_null()), len(limits), np.searchsorted(limits, known, "left"))
            yield pa.record_batch([pa.array(shard, pa.int32()), pa.array(known), pa.array(
                [encode(t) for t in batch.column(1).to_pylist()], pa.binary())], ["shard", "doc", "ids"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in texts_of(batches, 2048):
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for start, stop in zip(cuts, cuts[1:]):
                if writer is None or writer.shard != shard[start]:
                    if writer is not None:
                        yield pa.RecordBatch.from_pydict(writer.close())
                    writer = ShardWriter(folder, int(shard[start]), width)
                part = batch.slice(start, stop - start)
                writer.add(part.column(1).to_numpy(), part.column(2).to_pylist())
        if writer is not None:
            yield pa.RecordBatch.from_pydict(writer.close())

    tokens = source.mapInArrow(encoded, "shard int, doc long, ids binary")
    order = ["shard", F.when(F.col("doc") == NULL_ID, 1).otherwise(0), "doc", "ids"]
    done = (tokens.repartitionById(shards, F.col("shard")).sortWithinPartitions(*order)
            .mapInArrow(written, "shard long, docs long, tokens long").collect())
    done = sorted(done, key=lambda r: r["shard"])
    bases = [0, *accumulate(r["tokens"] for r in done)]
    index = {"dtype": width, "shards": [{"shard": r["shard"], "docs": r["docs"], "tokens": r["tokens"], "base": b}
                                        for r, b in zip(done, bases)]}
    files, base = store(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped into memory in a local folder, read through its file system elsewhere."""
    files, base = store(folder)
    path = f"{base}/{name}"
    if files.type_name == "local":
        size = files.get_file_info(path).size // np.dtype(dtype).itemsize
        return np.memmap(path, dtype, "r", shape=(size,)) if size else np.empty(0, dtype)
    with files.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document read back: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit), and the ids."""
    ship_package(spark)
    files, base = store(folder)
    with files.open_input_file(f"{base}/index.json") as source:
        index = json.loads(source.read())
    dtype = index["dtype"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                ids, docs = mapped(folder, f"ids-{shard}.bin", dtype), mapped(folder, f"docs-{shard}.bin", "<i8")
                offsets = mapped(folder, f"offsets-{shard}.bin", "<i8")
                for at in range(0, len(docs), 2048):
                    some, cut = np.array(docs[at:at + 2048]), np.array(offsets[at:at + 2049])
                    parts = [np.asarray(ids[a:b]).astype("<u4") for a, b in zip(cut, cut[1:])]
                    columns = [pa.array(some, mask=some == NULL_ID), pa.array(first + cut[:-1]), pa.array(np.diff(cut)),
                               pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([p.astype("i8") for p in parts], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.record_batch(columns, names)

    listed = spark.createDataFrame([(s["shard"], s["base"]) for s in index["shards"]], "shard long, base long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return listed.repartition(max(1, len(index["shards"])), "shard").mapInArrow(rows, schema)


def token_file_report(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return what a reader sees."""
    folder = fresh_dir(spark, "tokens")
    write_token_files(docs, folder, tokenizer)
    return read_token_files(spark, folder)
