"""The prefix trie of conversations, from padded matrices of turn ids in lexicographic order.

A turn's id is 16 bytes of a SHA-256 over its role and text. A conversation is a row of ids, padded where it is short.
Rows are dealt to shards by ranges of their ids, so a shard is a stretch of the lexicographic order. In a shard numpy sorts
the rows column block by column block, marks where a column changes from one row to the next, and the OR-accumulated marks
say from which depth on a row starts nodes of its own: its common prefix with the row before. At every depth, ``reduceat``
over the starts gives each node's members, smallest member, children, leaves below and tokens saved; all of these are
sums or minima over members, as

* a row is the last one of a leaf unless the next row begins with all of it, and
* the words that members save below a node are, per member but the first, its words from the node's depth on up to the
  depth of its common prefix with the row before.

Each shard also gets the last row of the shard before and the first of the next, so these marks are right at its ends. Only
nodes that hold a shard's first or last row and go on beyond it are partial there; their parts are summed over shards and
go back to the shards, which then write every node, a cut one where it starts.

What no other conversation shares needs no matrix: a conversation's row ends with the first block of ``BLOCK`` turns whose
preceding turns no other has (found by sums of hashes of whole blocks), and the rest of it is a chain whose nodes have one
member. So a conversation with a third of all turns is a short row, and its blocks and its chain are spread. A row is as long
as the longest prefix that two conversations share.

Digests of the members that end in a node are taken where they are sorted; of a cut node, shards hand over runs of ids,
and one stream hashes them in order, as SHA-256 can't be split.

Defined cases: rows are ordered by turn (null first), then role, the first characters of the text, and the id; a null
role or text is empty; rows with a null conversation id belong to no conversation; repeated rows are turns of their own; a
conversation may be turnless; an empty table has no nodes. Extra columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import counted_join, materialise, ship_package, shuffle_parts, word_count

WIDTH = 16
#: Turns of a block, and columns of the matrix that are compared together.
BLOCK = 64
HEAD = 64
#: Depths of a chain that one task writes together, and ids in a run of a cut node's members.
CHAIN, RUN = 4096, 4096
#: The rule by which conversations are rebuilt: the group of conversations whose first one lends turns, and most turns lent less one.
GROUP, LENT = 20, 4
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string")
NONE_SHA = hashlib.sha256(b"").hexdigest()


def turn_rows(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, head, id, words`` of every turn of a conversation."""
    said = chats.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return said.select("conv", "turn", "role", F.substring("text", 1, HEAD).alias("head"),
                       F.substring(F.unhex(F.sha2(whole, 256)), 1, WIDTH).alias("id"), word_count(F.col("text")).alias("words"))


def placed(turns: DataFrame) -> DataFrame:
    """``conv, pos, id, words``: every turn's place in its conversation, from 0.

    Turns are dealt by ranges of their whole order, so no conversation is too long for a task. A task counts within its
    range; only a conversation that began in an earlier range needs an offset, at most one per range.
    """
    spark, order = turns.sparkSession, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("id")]
    spread = turns.withColumn("any", F.monotonically_increasing_id())  # equal rows can be told apart in any way

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            conv = batch.column(1).to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            if conv[0] == last:
                first = starts[1] if len(starts) > 1 else len(conv)
                at[:first] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(at), batch.column(2), batch.column(3)],
                                  ["part", "conv", "at", "id", "words"])

    dealt = spread.repartitionByRange(shuffle_parts(spark), *order, F.col("any")).sortWithinPartitions(*order)
    table = materialise(dealt.select(F.spark_partition_id().alias("part"), "conv", "id", "words").mapInArrow(
        counted, "part int, conv long, at long, id binary, words long"), "trie-placed")
    sizes = table.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    ranges = sizes.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"))
    near = Window.orderBy("part")  # one row per range
    cut = ranges.withColumn("before", F.lag("last").over(near)).filter("first = before").select("part", F.col("first").alias("conv"))
    parts = sizes.join(F.broadcast(cut.select("conv").distinct()), "conv")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("conv", "part", F.sum("n").over(earlier).alias("offset")).filter("offset > 0")
    return table.join(F.broadcast(offsets), ["conv", "part"], "left").select(
        "conv", (F.col("at") + F.coalesce("offset", F.lit(0))).alias("pos"), "id", "words")


def rebuilt(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv, depth, id, words`` of the rebuilt conversations, and ``conv, n`` with their lengths.

    The first h turns come from the first conversation of the group, the others are the conversation's own; h depends on
    its id.
    """
    sizes = materialise(places.groupBy("conv").agg(F.count(F.lit(1)).alias("own")), "trie-sizes")
    base = F.col("conv") - F.pmod(F.col("conv"), F.lit(GROUP))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(LENT))
    firsts = sizes.filter(F.pmod("conv", F.lit(GROUP)) == 0).select(F.col("conv").alias("base"), F.col("own").alias("lent"))
    plan = (sizes.withColumn("base", base).withColumn("h", h).join(firsts, "base", "left")
            .withColumn("k", F.least("h", F.coalesce("lent", F.lit(0)))))
    plan = materialise(plan.select("conv", "base", "own", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")),
                       "trie-plan")
    heads = places.filter((F.col("pos") < LENT - 1) & (F.pmod("conv", F.lit(GROUP)) == 0)).withColumnRenamed("conv", "base")
    lent = plan.filter("k > 0").join(heads, "base").filter("pos < k").select("conv", (F.col("pos") + 1).alias("depth"), "id", "words")
    own = counted_join(places, plan.select("conv", "own", "h", "k"), ["conv"], "own").filter("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "id", "words")
    return lent.unionByName(own), plan.select("conv", "n")


def shared_rows(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv, n, key, words``: each conversation's ids and word counts up to the end of the block where it is alone."""
    turn = F.struct("depth", "id", "words")
    blocks = turns.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK)).groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"))
    blocks = blocks.select("conv", "block", F.transform("turns", lambda t: t["id"]).alias("ids"),
                           F.transform("turns", lambda t: t["words"]).alias("words"))
    blocks = materialise(blocks, "trie-blocks")
    long = lengths.filter(F.col("n") > BLOCK).select("conv")  # with one block there is nothing to find
    marks = [F.shiftrightunsigned(F.xxhash64(F.lit(k), "block", "ids"), 33).alias(f"m{k}") for k in range(4)]
    several = blocks.join(long, "conv", "left_semi").select("conv", "block", *marks)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"s{k}" for k in range(4)]
    prefixes = several.select("conv", "block", *[F.sum(f"m{k}").over(before).alias(f"s{k}") for k in range(4)]).filter("block > 0")
    prefixes = materialise(prefixes, "trie-prefixes")
    met = materialise(prefixes.groupBy("block", *names).agg(F.count(F.lit(1)).alias("of")).filter("of > 1"), "trie-met")
    going = counted_join(prefixes, met, ["block", *names], "of").select("conv", "block")
    kept = blocks.filter("block = 0").unionByName(blocks.filter("block > 0").join(going, ["conv", "block"]))
    part = F.array_sort(F.collect_list(F.struct("block", "ids", "words")))
    rows = kept.groupBy("conv").agg(part.alias("parts")).select(
        "conv", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.flatten(F.transform("parts", lambda p: p["words"])).alias("words"))
    whole = lengths.join(rows, "conv", "left")
    ids = F.coalesce("ids", F.array().cast("array<binary>"))
    return whole.select("conv", "n", F.unhex(F.array_join(F.transform(ids, F.hex), "")).alias("key"),
                        F.coalesce("words", F.array().cast("array<long>")).alias("words"))


def ranked(keys: list[bytes], trimmed: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' lexicographic order, and each sorted row's common prefix with the one before (-1 for the first).

    Of equal keys, whole conversations precede one that goes on alone, and smaller ids come first. Columns are compared in
    blocks; a row takes part as long as it is tied with another, so a matrix holds only what is shared.
    """
    sizes = np.array([len(k) // WIDTH for k in keys], np.int64)
    flat = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
    # ids become codes from 1 in the order of their bytes; padding is 0
    by_id = np.lexsort((flat[:, 1], flat[:, 0]))
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[by_id][1:] != flat[by_id][:-1]).any(axis=1)
    codes = np.empty(len(flat), np.int64)
    codes[by_id] = np.cumsum(fresh)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    order, common = np.arange(len(keys)), np.full(len(keys), -1, np.int64)
    group, tied, column = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    while len(tied):  # places in ``order`` whose rows are equal in all earlier columns to another's
        rows = order[tied]
        at = column + np.arange(BLOCK)
        inside = at[None, :] < sizes[rows][:, None]
        matrix = np.zeros((len(rows), BLOCK), np.int64)
        matrix[inside] = codes[(starts[rows][:, None] + at[None, :])[inside]]
        best = np.lexsort((conv[rows], trimmed[rows], *matrix.T[::-1], group[tied]))
        order[tied], matrix = rows[best], matrix[best]
        rows = order[tied]
        first = np.concatenate(([True], group[tied][1:] != group[tied][:-1]))
        changed = np.zeros((len(rows), BLOCK), bool)
        changed[1:] = matrix[1:] != matrix[:-1]
        changed = np.logical_or.accumulate(changed, axis=1)  # from the first change on, nodes are the row's own
        alike = (~changed & (matrix > 0)).sum(axis=1)
        common[tied[~first]] = np.where(common[tied[~first]] < 0, 0, common[tied[~first]]) + alike[~first]
        splits = first | changed[:, -1]
        block = np.cumsum(splits)
        many = np.bincount(block)[block] > 1
        going = np.zeros(block[-1] + 1, bool)
        np.logical_or.at(going, block, sizes[rows] > column + BLOCK)
        keep = many & going[block]
        group[tied] = block
        tied, column = tied[keep], column + BLOCK
    return order, common


class Shard:
    """The sorted rows of a shard with its neighbours' nearest rows, and what each depth's nodes are."""

    def __init__(self, table: pa.Table):
        conv, n = table.column("conv").to_numpy(), table.column("n").to_numpy()
        keys, words = table.column("key").to_pylist(), table.column("words").combine_chunks()
        self.side = table.column("side").to_numpy()
        sizes = np.array([len(k) // WIDTH for k in keys], np.int64)
        order, common = ranked(keys, n > sizes, conv)
        if isinstance(words, pa.ChunkedArray):
            words = pa.concat_arrays(words.chunks)
        offsets = words.offsets.to_numpy()
        sums = np.concatenate(([0], np.cumsum(words.values.to_numpy(zero_copy_only=False))))
        self.sums, self.start = sums, offsets[:-1][order]
        self.conv, self.n, self.side = conv[order], n[order], self.side[order]
        self.keys, self.order = keys, order
        real = np.flatnonzero(self.side == 0)
        self.low, self.high = int(real[0]), int(real[-1]) + 1  # neighbours come before and after
        after = np.append(common[1:], -1)
        self.common, self.leaf = common, (after < self.n).astype(np.int64)
        self.shared = np.maximum(np.maximum(common, after), 0)
        self.left, self.right = int(common[self.low]), int(after[self.high - 1])  # depths shared beyond the ends
        self.below = np.where(common > 0, self.prefix(np.arange(len(order)), np.maximum(common, 0)), 0)

    def prefix(self, rows: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """Words of the first turns of rows."""
        return self.sums[self.start[rows] + depth] - self.sums[self.start[rows]]

    def paths(self) -> Iterator[tuple[int, bytes]]:
        """Depth and key of every node that goes on beyond an end of the shard, each once."""
        seen = set()
        for row, depth in ((self.low, self.left), (self.high - 1, self.right)):
            key, state = self.keys[self.order[row]], hashlib.sha256()
            for d in range(depth + 1):
                if d:
                    state.update(key[(d - 1) * WIDTH:d * WIDTH])
                name = d, state.copy().digest()
                if name not in seen:
                    seen.add(name)
                    yield name

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
        """Per depth that is shared: the rows there, where nodes start among them, and the nodes' values."""
        rows = np.arange(self.low, self.high)
        depth = 0
        while len(rows):
            starts = np.flatnonzero(self.common[rows] < depth)
            if not len(starts) or starts[0]:
                starts = np.concatenate(([0], starts))  # a node that began in an earlier shard
            after = np.append(starts[1:], len(rows))
            again = self.common[rows] >= depth
            child = (self.common[rows] <= depth) & (self.n[rows] > depth)
            saved = np.where(again, self.below[rows] - (self.prefix(rows, depth - 1) if depth else 0), 0)
            add = lambda x: np.add.reduceat(x.astype(np.int64), starts)  # noqa: B023, E731
            yield depth, rows, starts, {
                "conv_id": np.minimum.reduceat(self.conv[rows], starts), "n_convs": after - starts, "n_children": add(child),
                "n_leaves": add(self.leaf[rows]), "saved_tokens": add(saved), "ends": add(self.n[rows] == depth)}
            depth += 1
            rows = rows[self.shared[rows] >= depth]

    def ends(self, rows: np.ndarray, start: int, many: int) -> np.ndarray:
        """Members that end in the node that starts at a place of ``rows``; they come first, in order of their ids."""
        return self.conv[rows[start:start + many]]


def with_neighbours(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges to shards, each with its neighbours' nearest rows (``side`` -1 and 1)."""
    spark = rows.sparkSession
    order = [F.col("key"), (F.length("key") < F.col("n") * WIDTH).alias("more"), F.col("conv")]
    dealt = rows.repartitionByRange(shuffle_parts(spark), F.col("key"), F.length("key") < F.col("n") * WIDTH, F.col("conv"))
    table = materialise(dealt.select(F.spark_partition_id().alias("shard"), "conv", "n", "key", "words"), "trie-shards")
    place = F.struct(*order)
    row = F.struct("conv", "n", "key", "words")
    # the nearest rows: one per shard, each looked up by its place among the shards that have rows
    near = Window.orderBy("shard")
    ends = table.groupBy("shard").agg(F.min_by(row, place).alias("first"), F.max_by(row, place).alias("last"))
    ends = ends.select("shard", F.lag("last").over(near).alias("before"), F.lead("first").over(near).alias("after"))
    ends = materialise(ends, "trie-ends")
    beside = ends.select("shard", "before.*", F.lit(-1).alias("side")).unionByName(ends.select("shard", "after.*", F.lit(1).alias("side")))
    return materialise(table.withColumn("side", F.lit(0)).unionByName(beside.filter("conv is not null")), "trie-beside")


PART = "depth long, key binary, shard int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def cut_nodes(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of the nodes that go on beyond their shard, and the runs of ids of their members that end there."""

    def parts(table: pa.Table) -> pa.Table:
        shard, rows_out = Shard(table), {f.split()[0]: [] for f in PART.split(", ")}
        runs: list[list[tuple[int, bytes]]] = []
        names: dict[int, list[bytes]] = {}
        for depth, key in shard.paths():
            names.setdefault(depth, []).append(key)
        for depth, rows, starts, values in shard.levels():
            if depth not in names:
                break
            for key, at in zip(names[depth], shard_nodes(shard, depth, rows, starts)):
                many = int(values["ends"][at])
                ids = shard.ends(rows, int(starts[at]), many)
                runs.append([(i, ",".join(map(str, ids[i:i + RUN].tolist())).encode()) for i in range(0, many, RUN)])
                for name, value in (("depth", depth), ("key", key), ("shard", table.column("shard")[0].as_py()),
                                    *[(k, int(values[k][at])) for k in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]):
                    rows_out[name].append(value)
        runs_type = pa.list_(pa.struct([("at", pa.int64()), ("ids", pa.binary())]))
        kinds = {"key": pa.binary(), "shard": pa.int32()}
        arrays = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows_out.items()}
        return pa.table({**arrays, "runs": pa.array([[{"at": a, "ids": b} for a, b in r] for r in runs], runs_type)})

    found = shards.groupBy("shard").applyInArrow(parts, PART + ", runs array<struct<at:long,ids:binary>>")
    found = materialise(found, "trie-cut")
    return found.drop("runs"), found.select("depth", "key", "shard", F.inline("runs"))


def shard_nodes(shard: Shard, depth: int, rows: np.ndarray, starts: np.ndarray) -> list[int]:
    """Which of the nodes at a depth go on beyond an end, in the order of ``paths``."""
    out = [0] if depth <= shard.left else []
    if depth <= shard.right and len(starts) - 1 not in out:
        out.append(len(starts) - 1)
    return out


def streamed(runs: DataFrame) -> DataFrame:
    """``depth, key, ends_sha256``: the digest of each node's runs of ids, in order, joined by commas."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None

        def close() -> pa.RecordBatch:
            return pa.record_batch([pa.array([last[0]]), pa.array([last[1]], pa.binary()), pa.array([state.hexdigest()])],
                                   ["depth", "key", "ends_sha256"])

        for batch in batches:
            for depth, key, ids in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                if (depth, key) != last:
                    if last is not None:
                        yield close()
                    last, state = (depth, key), hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
        if last is not None:
            yield close()

    place = ["depth", "key", "shard", "at"]
    ordered = runs.repartition(shuffle_parts(runs.sparkSession), "depth", "key").sortWithinPartitions(*place)
    return ordered.select("depth", "key", "ids").mapInArrow(digests, "depth long, key binary, ends_sha256 string")


FINAL = NODE + ", chain boolean"


def written(shards: DataFrame, cut: DataFrame, runs: DataFrame) -> DataFrame:
    """All shared nodes, and a row per conversation that goes on alone (``chain``: its last shared depth and its length)."""
    sums = cut.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), *[
        F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    sums = sums.join(streamed(runs), ["depth", "key"], "left").fillna(NONE_SHA, ["ends_sha256"])
    known = materialise(cut.select("depth", "key", "shard").join(sums, ["depth", "key"]), "trie-known")

    def nodes(table: pa.Table, totals: pa.Table) -> pa.Table:
        shard = Shard(table)
        total = {(r["depth"], r["key"]): r for r in totals.to_pylist()}
        names: dict[int, list[bytes]] = {}
        for depth, key in shard.paths():
            names.setdefault(depth, []).append(key)
        fields = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        out: dict[str, list[np.ndarray]] = {f: [] for f in fields}
        shas: list[str] = []
        parent = np.zeros(len(shard.conv), np.int64)  # of each row, the smallest member of its node one depth above
        for depth, rows, starts, values in shard.levels():
            own = np.ones(len(starts), bool)
            sha = [""] * len(starts)
            for key, at in zip(names.get(depth, []), shard_nodes(shard, depth, rows, starts)):
                row = total[depth, key]
                for name in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"):
                    values[name][at] = row[name]
                sha[at] = row["ends_sha256"]
                own[at] = not (at == 0 and depth <= shard.left)  # a node is written where it starts
            for at in np.flatnonzero(own).tolist():
                if not sha[at]:
                    many = int(values["ends"][at])
                    ids = shard.ends(rows, int(starts[at]), many).tolist()
                    sha[at] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if many else NONE_SHA
            for name in fields:
                column = (np.full(len(starts), depth) if name == "depth" else parent[rows[starts]] if name == "parent_conv_id" else values[name])
                out[name].append(column[own].astype(np.int64))
            shas += [s for s, mine in zip(sha, own) if mine]
            parent[rows] = np.repeat(values["conv_id"], np.diff(np.append(starts, len(rows))))
        rows = np.arange(shard.low, shard.high)
        alone = rows[shard.n[rows] > shard.shared[rows]]
        none = np.zeros(len(alone), np.int64)
        chains = [shard.conv[alone], shard.shared[alone], parent[alone], none, shard.n[alone], none, none]
        columns = {f: np.concatenate([*out[f], c]) for f, c in zip(fields, chains)}
        arrays = {f: pa.array(v) for f, v in columns.items()}
        shared = len(shas)
        root = columns["depth"][:shared] == 0
        arrays["parent_conv_id"] = pa.array(columns["parent_conv_id"], mask=np.concatenate((root, np.zeros(len(alone), bool))))
        return pa.table({**arrays, "ends_sha256": pa.array(shas + [None] * len(alone), pa.string()),
                         "chain": pa.array(np.arange(shared + len(alone)) >= shared)})

    done = shards.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(nodes, FINAL)
    return materialise(done, "trie-nodes")


def chains(alone: DataFrame) -> DataFrame:
    """The nodes with one member: ``n_children`` of the given rows is the conversation's length, ``depth`` its last shared one."""
    first, length = F.col("depth") + 1, F.col("n_children")
    runs = alone.withColumn("from", F.explode(F.sequence(first, length, F.lit(CHAIN).cast("long"))))
    runs = runs.repartition(shuffle_parts(alone.sparkSession), "conv_id", "from")
    each = runs.withColumn("at", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHAIN - 1, length))))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    last = F.col("at") == length
    return each.select("conv_id", F.col("at").alias("depth"), F.when(F.col("at") == first, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                       one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
                       F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NONE_SHA)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations: ``turns(conv, depth, id, words)``, depths from 1 without gaps, and
    ``lengths(conv, n)``, which names turnless ones too."""
    ship_package(turns.sparkSession)
    shards = with_neighbours(shared_rows(turns, lengths))
    nodes = written(shards, *cut_nodes(shards))
    columns = [f.split()[0] for f in NODE.split(", ")]
    return nodes.filter("not chain").select(*columns).unionByName(chains(nodes.filter("chain")).select(*columns))


def conversation_trie(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of rebuilt conversations: a row per distinct prefix of turns."""
    turns, lengths = rebuilt(placed(turn_rows(chats, conv_id, turn, role, text)))
    return prefix_trie(turns, lengths)


ORACLE = r"""
with recursive placed as (
  select conv_id as conv, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
sizes as (select conv, count(*) as own from placed group by conv),
hashed as (
  select conv, own, conv - ((conv % 20) + 20) % 20 as base, xor(4294967295, list_reduce(
      list_concat([4294967295::bigint], list_transform(range(length(conv::varchar)), lambda i: ascii(substr(conv::varchar, (i + 1)::int, 1))::bigint)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, (a & 1) * 3988292384)))) % 4 as h
  from sizes),
plan as (
  select a.conv, a.base, a.h, least(a.h, coalesce(b.own, 0)) as k, least(a.h, coalesce(b.own, 0)) + greatest(a.own - a.h, 0) as n
  from hashed a left join sizes b on a.base = b.conv),
turns as (
  select p.conv, t.pos + 1 as depth, t.role, t.text from plan p join placed t on t.conv = p.base and t.pos < p.k
  union all
  select p.conv, t.pos - p.h + p.k + 1, t.role, t.text from plan p join placed t on t.conv = p.conv and t.pos >= p.h),
members as (
  select conv, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words,
         sha256(string_agg(sha256(length(role) || ':' || role || text), '') over (partition by conv order by depth)) as p from turns
  union all select conv, 0, 0, '' from plan),
nodes as (select p, depth, min(conv) as conv_id, count(*) as n_convs, any_value(words) as words from members group by p, depth),
parents as (
  select n.p, n.depth, u.p as parent, u.conv_id as parent_conv_id
  from nodes n join members m on m.conv = n.conv_id and m.depth = n.depth - 1 join nodes u on u.p = m.p and u.depth = m.depth),
children as (select parent as p, depth - 1 as depth, count(*) as n_children from parents group by 1, 2),
below as (
  select m.p, m.depth, count(*) filter (c.p is null) as n_leaves, sum((w.n_convs - 1) * w.words) as saved_tokens
  from nodes w left join children c on c.p = w.p and c.depth = w.depth
  join members m on m.conv = w.conv_id and m.depth <= w.depth group by 1, 2),
ends as (
  select m.p, m.depth, string_agg(m.conv::varchar, ',' order by m.conv) as ids
  from members m join plan on plan.conv = m.conv and plan.n = m.depth group by 1, 2)
select n.conv_id, n.depth::bigint as depth, u.parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, b.n_leaves,
       b.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n left join parents u on u.p = n.p and u.depth = n.depth left join children c on c.p = n.p and c.depth = n.depth
join below b on b.p = n.p and b.depth = n.depth left join ends e on e.p = n.p and e.depth = n.depth
"""
