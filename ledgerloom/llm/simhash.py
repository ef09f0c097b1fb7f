"""SimHash near-duplicates by bit-sliced comparison.

A text's words are lower-cased (A-Z only) and taken in shingles of three, repeats included; each shingle's XXH64
votes on 64 bits. Two fingerprints link at ``RADIUS`` or fewer differing bits.

Distinct fingerprints are compared, never documents. The 64 bits are cut into six pieces; fingerprints within
radius 3 agree on some three of them, so each of the 20 choices of three pieces is a key of about 32 bits under
which all links meet. Members of a key are stored as vertical bit planes, and one query's distances to all lanes of
a block advance together: a plane of differences is added to carry-save counters of two bits, a third plane keeps
the lanes that passed the radius, and a query leaves a block as soon as all its lanes have. Keys with more members
than ``CELL`` are cut into parts, and each pair of parts is a cell of its own, so no task holds more than two parts.

Defined cases: a null text and a text without words have fingerprint zero and link like any other; one or two words
are one shingle; rows with a null id keep their fingerprint and get the component of their texts' other ids, null if
there is none; repeated rows stay. Extra columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_order, materialise, ship_package, shuffle_parts, texts_of
from ledgerloom.llm.graph import components

RADIUS, SEED, SHINGLE = 3, 42, 3
#: Widths of the six pieces; three differing bits leave at least three pieces equal.
PIECES = (11, 11, 11, 11, 10, 10)
#: Most members of a part of a hot key, and lanes of a block of small keys compared together.
CELL, LANES, QUERIES = 8192, 512, 512
VOTES = 1 << 16


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text, in order."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    spans = zip(starts[:len(words) - shingle + 1].tolist(), stops[shingle - 1:].tolist())
    return np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64, len(words) - shingle + 1)


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint as an unsigned integer: a bit is set where over half of the hashes have it."""
    hashes = shingle_hashes(text)
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), VOTES):  # a slice at a time: 64 bytes a shingle
        part = hashes[start:start + VOTES].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, mark, fp)`` per row: its id, a hash of its text, and the fingerprint's bits as a signed long."""
    ship_package(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_of(batches):
            bits = np.array([fingerprint(t or "") for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bits.view(np.int64))], ["doc", "mark", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(
        hashed, "doc long, mark long, fp long")


def near(queries: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, lane) of all pairs within ``radius`` (0 to 3) bits, by carry-save counting over bit planes."""
    width = -(-len(lanes) // 64)
    padded = np.zeros(width * 64, np.uint64)
    padded[:len(lanes)] = lanes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    planes = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)  # plane b, word w: bit b of 64 lanes
    full = np.uint64(2**64 - 1)
    rows, columns = [], []
    for start in range(0, len(queries), QUERIES):
        asked = queries[start:start + QUERIES]
        alive = np.arange(len(asked))
        masks = np.unpackbits(asked.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.uint64) * full
        ones, twos, far = (np.zeros((len(asked), width), np.uint64) for _ in range(3))
        for bit in range(64):
            carry = planes[bit] ^ masks[:, bit, None]
            ones, carry = ones ^ carry, ones & carry
            twos, carry = twos ^ carry, twos & carry
            far |= carry
            if bit % 8 == 7 and bit < 63:
                going = (far != full).any(axis=1)
                if not going.all():
                    alive, masks, ones, twos, far = (x[going] for x in (alive, masks, ones, twos, far))
                    if not len(alive):
                        break
        if not len(alive):
            continue
        beyond = {3: far, 2: far | (ones & twos), 1: far | twos, 0: far | twos | ones}[radius]
        hit = np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little", count=len(lanes))
        q, lane = np.nonzero(hit)
        rows.append(start + alive[q])
        columns.append(lane)
    none = np.empty(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(columns or [none])


def joined_labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position of each position's group under the given pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            if not (low != high).any():
                break
            np.minimum.at(label, high, low)
            while (label != label[label]).any():
                label = label[label]
    return label


def forest(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join distinct ``marks`` as all pairs within the radius would, one for each joined mark."""
    marks = np.unique(marks)

    def pairs():
        for start in range(0, len(marks), QUERIES):
            q, lane = near(marks[start:start + QUERIES], marks)
            keep = lane > q + start
            yield q[keep] + start, lane[keep]

    label = joined_labels(len(marks), pairs())
    child = np.flatnonzero(label != np.arange(len(marks)))
    return marks[child], marks[label[child]]


def key_masks() -> list[int]:
    """Masks of every three of the six pieces, as signed 64-bit integers."""
    ends = np.cumsum(PIECES).tolist()
    pieces = [((1 << w) - 1) << (e - w) for w, e in zip(PIECES, ends)]
    masks = [sum(pieces[i] for i in some) for some in combinations(range(len(PIECES)), len(PIECES) - RADIUS)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def links(marks: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that connect all within the radius of each other."""
    masks = key_masks()
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                     for t, m in enumerate(masks)])
    keyed = marks.select("fp", F.inline(keys))
    hot = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
    hot = hot.select("t", "key", F.ceil(F.col("n") / cell).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    cells = (keyed.join(hot, ["t", "key"], "left").withColumn("mine", F.coalesce(part, F.lit(0)))
             .withColumn("other", other)
             .select("t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[np.ndarray] = []
        held, last, lanes = [], None, 0

        def close() -> pa.RecordBatch:
            a, b = forest(np.concatenate(block).view(np.uint64)) if block else (np.empty(0, np.uint64),) * 2
            return pa.record_batch([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        def group() -> None:
            nonlocal lanes
            members = np.concatenate(held)
            if len(members) > 1:
                block.append(members)
                lanes += len(members)

        for batch in batches:
            fp = batch.column(4).to_numpy()
            names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])
            cuts = [0, *(np.flatnonzero((np.diff(names) != 0).any(axis=0)) + 1).tolist(), len(fp)]
            for start, stop in zip(cuts, cuts[1:]):
                name = tuple(names[:, start])
                if name != last and held:
                    group()
                    held.clear()
                    if lanes >= LANES:
                        yield close()
                        block.clear()
                        lanes = 0
                last = name
                held.append(fp[start:stop])
        if held:
            group()
        yield close()

    order = ["t", "key", "i", "j"]
    parts = shuffle_parts(marks.sparkSession)
    return cells.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(compared, "a long, b long")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, mark, fp, root`` per row; rows linked, directly or not, have one ``root``."""
    table = materialise(fingerprints(docs, doc_id, text), "simhash")
    marks = materialise(table.select("fp").distinct(), "simhash-marks")
    roots = components(links(marks))
    named = marks.join(roots, marks.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return table.join(named, "fp")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id linked, directly or not) per row."""
    rows = grouped(docs, doc_id, text)
    smallest = rows.groupBy("root").agg(F.min("doc").alias("component_id"))
    return rows.join(smallest, "root").select(
        F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group one row stays, that of the smallest id.

    Null ids come last; texts with the same id go by their hashes, and of rows equal in id and text any one stays.
    """
    return keep_least(docs, grouped(docs, doc_id, text), doc_id, text)


def keep_least(docs: DataFrame, rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of ``docs`` with the smallest id of each ``root`` of ``rows(doc, mark, root)``."""
    least = F.min(F.struct(id_order(F.col("doc")).alias("doc"), F.col("mark").alias("mark"))).alias("least")
    kept = rows.groupBy("root").agg(least).select(
        F.col("least.doc").alias("_doc"), F.col("least.mark").alias("_mark")).distinct()
    packed = docs.select(F.struct("*").alias("row"), id_order(F.col(doc_id)).alias("_doc"), F.xxhash64(text).alias("_mark"))
    return packed.join(kept, ["_doc", "_mark"], "left_semi").dropDuplicates(["_doc", "_mark"]).select("row.*")
