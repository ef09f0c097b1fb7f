"""Near-duplicates by Jaccard similarity of word shingles: SimHash proposes pairs, exact similarity decides.

A text's words are lower-cased (A-Z only); its set holds the XXH64 of every run of ``SHINGLE`` words, each once. Texts
are linked where the sets' similarity is ``LEAST`` or more. Texts with equal sets are one node, and nodes are compared.

A node's fingerprint has 128 bits, each a majority vote of the set's hashes. At similarity 0.8 the cosine of two sets is
8/9 or more and a bit differs with probability 0.152 (0.19 in sets of four and five), so all but about 3 pairs in 1000
are within ``RADIUS`` bits. Nodes meet under ``TABLES`` keys of ``KEY_BITS`` random bits: a pair at 0.8 misses all keys
with probability 0.001 (0.016 in sets of four and five), closer pairs less. Members of a key are compared as vertical
bit planes by carry-save counting, and 64 lanes are abandoned together once all of them are beyond the radius.

A pair within the radius must pass a bound before it leaves its cell: a node has ``PARITY`` bits, each the parity of the
number of its hashes that fall there, and two sets differ in at least as many hashes as these bits differ. A pair whose
bits differ more than similarity ``LEAST`` allows is under it for certain, so texts within the radius but unlike each other
stay pairs in a worker's slice. The others are verified on the whole sets. Two rounds over few keys propose one preceding
partner per node, which joins groups of copies without pairing all their members. The last round proposes, under all keys,
every pair that the verified links have not joined yet, so a rejected partner costs no link.

Defined cases: null texts and texts without words are one node; texts of fewer words than a shingle are one shingle; rows
with a null id are rows of their own and follow those with an id; repeated rows, equal in id and text, count as one; texts
with the same id are told apart by their hashes; an empty table gives an empty one. Extra columns are kept and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import let_go, materialise, ship_package, shuffle_parts, texts_of
from ledgerloom.llm.graph import components
from ledgerloom.llm.simhash import LANES, QUERIES, SEED, VOTES, keep_least, shingle_hashes

SHINGLE, LEAST, RADIUS = 5, 0.8, 36
TABLES, KEY_BITS = 48, 12
#: Ranges of keys of the rounds that propose one partner per node.
ROUNDS = ((0, 2), (2, 8))
CELL = 2048
#: Bits of the parity bound, and pairs of a slice that a worker looks at together.
PARITY, SLICE = 512, 1 << 19
#: Planes after which lanes are abandoned: unlike texts differ in half of them.
CHECKED = (88, 108)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A second 64-bit hash of each hash (SplitMix64)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 majority bits as two signed longs."""
    votes = np.zeros((2, 64), np.int64)
    for start in range(0, len(hashes), VOTES):
        part = hashes[start:start + VOTES]
        for k, word in enumerate((part, mixed(part))):
            votes[k] += np.unpackbits(word.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(2 * votes > len(hashes), axis=1).view(">i8").ravel().tolist())


def parity(hashes: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls on each of ``PARITY`` places."""
    return np.packbits(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1).tobytes()


def carried(levels: list[list[np.ndarray]], level: int, plane: np.ndarray) -> None:
    """Add a plane of weight ``2**level`` to counters that hold at most two planes of each weight."""
    while True:
        if level == len(levels):
            levels.append([])
        levels[level].append(plane)
        if len(levels[level]) < 3:
            return
        a, b, c = levels[level]
        odd = a ^ b
        levels[level], plane, level = [odd ^ c], (a & b) | (odd & c), level + 1


def inside(levels: list[list[np.ndarray]], radius: int) -> np.ndarray:
    """Lanes whose count is at most the radius, as bits."""
    levels, level = [list(held) for held in levels], 0
    while level < len(levels):
        if len(levels[level]) == 2:
            a, b = levels[level]
            levels[level] = [a ^ b]
            carried(levels, level + 1, a & b)
        level += 1
    none = np.zeros_like(next(held[0] for held in levels if held))
    more, same = none.copy(), ~none
    for level in reversed(range(max(len(levels), radius.bit_length()))):
        count = levels[level][0] if level < len(levels) and levels[level] else none
        if radius >> level & 1:
            same &= count
        else:
            more |= same & count
            same &= ~count
    # a count with a smaller bit where the radius has one has left ``same`` and is no more
    return ~more


def within(queries: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and lane of all pairs (rows of 64-bit words) that differ in at most ``radius`` bits, by carry-save counting over planes."""
    words = lanes.shape[1]
    width = -(-len(lanes) // 64)
    padded = np.zeros((width * 64, words), np.uint64)
    padded[:len(lanes)] = lanes
    unpacked = lambda x: np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(unpacked(padded).T, axis=1, bitorder="little")).view(np.uint64)
    masks = unpacked(queries).astype(np.uint64) * np.uint64(2**64 - 1)
    levels: list[list[np.ndarray]] = [[]]
    alive = None  # query and word of the blocks of 64 lanes that still hold one inside
    for bit in range(64 * words):
        if alive is None:
            carried(levels, 0, planes[bit] ^ masks[:, bit, None])
        else:
            carried(levels, 0, planes[bit][alive[1]] ^ masks[alive[0], bit])
        if bit + 1 in CHECKED and radius < bit:
            going = inside(levels, radius) != 0
            levels = [[plane[going] for plane in held] for held in levels]
            alive = np.nonzero(going) if alive is None else (alive[0][going], alive[1][going])
            if not len(alive[0]):
                return alive[0], alive[0]
    hit = inside(levels, radius)
    if alive is None:
        alive = tuple(x.ravel() for x in np.indices(hit.shape))
    block, lane = np.nonzero(np.unpackbits(hit.reshape(-1, 1).view(np.uint8), axis=1, bitorder="little"))
    query, lane = alive[0][block], alive[1][block] * 64 + lane
    real = lane < len(lanes)
    return query[real], lane[real]


def proposed(members: np.ndarray, bits: np.ndarray, every: bool, salt: int, radius: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes within the radius, not joined yet and not under ``least`` by sizes or parities: all, or a preceding one
    per node; a slice at a time.

    ``members`` has a row of node, two fingerprint words, set size and root per member, ``bits`` its parities.
    """
    _, once = np.unique(members[:, 0], return_index=True)
    members, bits = members[once], bits[once]
    order = np.argsort(members[:, 0].view(np.uint64) * np.uint64(2 * salt + 1), kind="stable")
    members, bits = members[order], bits[order]
    node, marks, size, root = members[:, 0], members[:, 1:3].view(np.uint64), members[:, 3], members[:, 4]
    step = max(1, min(QUERIES, SLICE // max(1, len(node))))
    for start in range(0, len(node), step):
        stop = min(start + step, len(node))
        q, lane = within(marks[start:stop], marks[:stop], radius)
        q = q + start
        small, large = np.minimum(size[q], size[lane]), np.maximum(size[q], size[lane])
        good = (lane < q) & (root[q] != root[lane]) & (small >= least * large)
        q, lane = q[good], lane[good]
        differ = np.bitwise_count(bits[q] ^ bits[lane]).sum(axis=1, dtype=np.int64)
        good = differ * (1 + least) <= (size[q] + size[lane]) * (1 - least) + 1e-6
        q, lane = q[good], lane[good]
        if not every and len(q):
            last = np.lexsort((lane, q))
            q, lane = q[last], lane[last]
            last = np.append(q[1:] != q[:-1], True)
            q, lane = q[last], lane[last]
        yield node[q], node[lane]


def key_masks(tables: int = TABLES, bits: int = KEY_BITS) -> list[tuple[int, int]]:
    rng, out = np.random.default_rng(SEED), []
    for _ in range(tables):
        flags = np.zeros(128, bool)
        flags[rng.choice(128, bits, replace=False)] = True
        out.append(tuple(np.packbits(flags).view(">i8").tolist()))
    return out


def pairs(nodes: DataFrame, masks: list[tuple[int, int]], every: bool, salt: int, radius: int = RADIUS, least: float = LEAST,
          cell: int = CELL) -> DataFrame:
    """Distinct proposed pairs ``(a, b)`` of ``nodes(node, f1, f2, n, root, parity)`` under the given keys."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.col("f1").bitwiseAND(F.lit(one)), F.col("f2").bitwiseAND(F.lit(two))).alias("key"))
                     for t, (one, two) in enumerate(masks)])
    keyed = nodes.select("node", "f1", "f2", "n", "root", "parity", F.inline(keys))
    shared = (keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("of"), F.min("root").alias("low"), F.max("root").alias("high"))
              .filter("low != high").select("t", "key", F.ceil(F.col("of") / cell).cast("int").alias("parts")))
    # a table has at most 2**KEY_BITS keys, so however many nodes there are, these are TABLES * 2**KEY_BITS rows at most
    cells = (keyed.join(F.broadcast(shared), ["t", "key"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "node", "f1", "f2",
                     F.col("n").cast("long").alias("n"), "root", "parity"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        block: list[tuple[np.ndarray, np.ndarray]] = []
        last, lanes = None, 0

        def close() -> Iterator[pa.RecordBatch]:
            members, bits = np.concatenate([m for m, _ in block]), np.concatenate([b for _, b in block])
            block.clear()
            for a, b in proposed(members, bits, every, salt, radius, least):
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            names = batch.column(0).to_numpy()
            members = np.stack([batch.column(c).to_numpy() for c in range(1, 6)], axis=1)
            bits = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(len(names), -1)
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)] if len(names) else []
            for start, stop in zip(cuts, cuts[1:]):
                if names[start] != last and lanes >= LANES:
                    yield from close()
                    lanes = 0
                last = names[start]
                block.append((members[start:stop], bits[start:stop]))
                lanes += stop - start
        if block:
            yield from close()

    return (cells.repartition(shuffle_parts(nodes.sparkSession), "cell").sortWithinPartitions("cell")
            .mapInArrow(compared, "a long, b long").distinct())


def verified(found: DataFrame, docs: DataFrame, places: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE,
             least: float = LEAST) -> DataFrame:
    """The pairs ``(a, b)`` of ``found`` whose whole sets have similarity ``least``; ``places`` names a document per node."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in texts_of(batches):
            yield pa.record_batch([batch.column(0), pa.array([shingle_set(t or "", shingle).tobytes() for t in batch.column(1).to_pylist()],
                                                             pa.binary())], ["node", "hashes"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_of(batches):
            keep = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both / max(1, len(x) + len(y) - both) >= least)
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    needed = found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(places, "node")
    texts = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.xxhash64(text).alias("_mark"), F.col(text).alias("text"))
    texts = texts.join(needed, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_mark") == F.col("mark"))).dropDuplicates(["node"])
    known = materialise(texts.select("node", "text").mapInArrow(sets, "node long, hashes binary"), "similar-sets")
    left = found.join(known.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    return left.join(known.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(
        similar, "a long, b long")


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, least: float = LEAST, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``doc, mark, root`` per row; rows linked, directly or not, have one ``root``."""
    ship_package(docs.sparkSession)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        let_go()
        for batch in texts_of(batches):
            sets = [shingle_set(t or "", shingle) for t in batch.column(2).to_pylist()]
            marks = [fingerprint(s) for s in sets]
            node = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(node), *[pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)],
                                   pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(parity, sets)), pa.binary())],
                                  ["doc", "mark", "node", "f1", "f2", "n", "parity"])

    table = materialise(docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
                        .mapInArrow(signed, "doc long, mark long, node long, f1 long, f2 long, n long, parity binary"), "similar")
    nodes = materialise(table.groupBy("node").agg(*[F.first(c).alias(c) for c in ("f1", "f2", "n", "parity")],
                                                  F.min(F.struct("doc", "mark")).alias("place")), "similar-nodes")
    places = nodes.select("node", "place.doc", "place.mark")
    masks, links, roots = key_masks(), None, None
    for salt, (start, stop) in enumerate([*ROUNDS, (0, TABLES)]):
        rooted = nodes.select("node", "f1", "f2", "n", "parity")
        rooted = (rooted.withColumn("root", F.col("node")) if roots is None else
                  rooted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        found = materialise(pairs(materialise(rooted, "similar-rooted"), masks[start:stop], salt == len(ROUNDS), salt, radius, least), "similar-pairs")
        more = materialise(verified(found, docs, places, doc_id, text, shingle, least), "similar-links")
        links = more if links is None else links.union(more)
        roots = components(links)
    return table.join(roots, "node", "left").select("doc", "mark", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, least: float = LEAST, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of the smallest id stays, as in ``simhash.keep_one``."""
    return keep_least(docs, grouped(docs, shingle, radius, least, doc_id, text), doc_id, text)
