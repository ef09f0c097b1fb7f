"""SentencePiece encoding and decoding with the N best segmentations.

A model file's pieces span a lattice over the normalised text: an edge for every piece that matches at a place, and
one edge of a single character, spelt in byte pieces, where no piece of one character does. A merge vocabulary
scores a piece with minus its rank ``r``, so a piece costs minus the logarithm of its share under a Zipf law,
``ln(1 + r) + ln(sum over pieces of 1 / (1 + r))``, in whole millionths, which makes sums exact; another rule can be
given. A character without a piece costs the dearest piece and 10 more. The best segmentation has the least cost;
it isn't the merge order of byte-pair encoding, which has no N-best list.

The forward pass stores the least cost to every place (Viterbi). A* then runs backward from the end: the forward
costs are its exact heuristic, so complete paths leave the agenda best first. Of equal costs the one with the smaller
ids, read from the end, is the best, and the others come in the order found. Pieces have the blank mark only in front and never a line feed inside, so every segmentation has
cuts before a run of blank marks and around line feeds, and inside such a unit wherever no piece holds the two
characters next to each other: the lattice is a chain of small ones, each solved once per distinct unit and worker.
Units are rows of a memory of arrays. The new ones of a batch of texts are solved together: one walk through the trie
finds all their edges, and one forward pass goes over all of them, place by place. Long units and those with characters
that are no pieces are solved one by one, in parts.
A text's N best are found on the chain from the units where leaving the best costs least.

Defined cases: a null text encodes like an empty one, to no pieces, with score 0 and no alternatives; a text that
holds the blank mark itself decodes with a blank in its place (``round_trip`` is false there, as for texts that the
model's normaliser changes); ids outside the vocabulary decode as an error of the caller, null ids as null; repeated
rows and null document ids stay rows. Extra columns are never looked at.
"""

from __future__ import annotations

import heapq
import math
import random
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import let_go, once_per_worker, ship_package, single_thread, texts_of

BLANK = "▁"
NBEST = 4
#: Distinct units a worker remembers, about 300 bytes each (a full memory is emptied), and the longest of them.
CACHE, LONG_UNIT = 1_000_000, 48
#: Units whose N-best lists a worker remembers.
WAYS = 20_000
#: Units of texts looked up together, and the fewest new ones that are worth a pass over arrays.
TOGETHER, FEWEST = 1 << 16, 32
#: Characters of texts whose units are looked at together; a longer text stands alone.
CHARS = 1 << 20
NEVER = 1 << 62
ALTERNATIVES = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("edits", pa.list_(pa.struct(
    [("first", pa.int32()), ("removed", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def zipf_costs(scores: list[float]) -> list[int]:
    """Cost per piece from the file's scores."""
    whole = math.log(sum(1 / (1 - s) for s in scores))
    return [round(1e6 * (math.log(1 - s) + whole)) for s in scores]


def gathered(values: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of values, given by where they start and how long they are, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(firsts - ends + counts, counts) + np.arange(total)]


def with_room(column: np.ndarray, used: int, more: int) -> np.ndarray:
    """The column, or a larger copy if it can't take so many values more."""
    if used + more <= len(column):
        return column
    larger = np.empty(max(2 * len(column), used + more), column.dtype)
    larger[:used] = column[:used]
    return larger


class Rows(dict):
    """Row of every unit; a unit that is looked up without one gets the next and is noted as new."""

    def __init__(self):
        super().__init__()
        self.used, self.new = 0, []

    def __missing__(self, unit: str) -> int:
        row = self[unit] = self.used + len(self.new)
        self.new.append(unit)
        return row


class Memory:
    """Solved units: their ids one after another, and by row where these start, how many, the cost, and what the second best costs more."""

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.rows, self.stored = Rows(), 0
        self.ids, self.firsts, self.costs, self.gaps = np.empty(0, self.kind), *np.empty((3, 0), np.int64)
        self.counts = np.empty(0, np.int32)

    def add(self, ids: np.ndarray, counts: np.ndarray, costs: np.ndarray, gaps: np.ndarray) -> None:
        """Values of the new units, in their order."""
        used, more, stored = self.rows.used, len(counts), self.stored
        self.ids = with_room(self.ids, stored, len(ids))
        self.ids[stored:stored + len(ids)] = ids
        for name, values in (("firsts", np.cumsum(counts) - counts + stored), ("counts", counts), ("costs", costs), ("gaps", gaps)):
            column = with_room(getattr(self, name), used, more)
            column[used:used + more] = values
            setattr(self, name, column)
        self.stored += len(ids)
        self.rows.used, self.rows.new = used + more, []

    def __getitem__(self, unit: str) -> tuple[bytes, int, int]:
        row = dict.get(self.rows, unit)
        if row is None:
            raise KeyError(unit)
        first = self.firsts[row]
        return self.ids[first:first + self.counts[row]].tobytes(), int(self.costs[row]), int(self.gaps[row])


class PieceModel:
    """Pieces and costs of a SentencePiece file, with N-best encoding and decoding."""

    def __init__(self, path: str, costs: Callable[[list[float]], list[int]] = zipf_costs, remembered: int = CACHE):
        from sentencepiece import SentencePieceProcessor

        single_thread()
        self.processor = sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.vocabulary = {sp.id_to_piece(i): (i, c) for i, c in zip(plain, costs([sp.get_score(i) for i in plain]))}
        self.trie: dict = {}
        for text, (piece, price) in self.vocabulary.items():
            children = self.trie
            for k, symbol in enumerate(text, 1):
                known = children.get(symbol) or ({}, -1, 0)
                children[symbol] = (known[0], piece, price) if k == len(text) else known
                children = known[0]
        self.neighbours = {p[k:k + 2] for p in self.vocabulary for k in range(len(p) - 1)}
        self.longest = max(map(len, self.vocabulary))
        self.tables()
        self.unknown_cost = max(c for _, c in self.vocabulary.values()) + 10_000_000
        self.unknown = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in ids if sp.is_byte(i)}
        self.surface = [sp.id_to_piece(i).replace(BLANK, " ").encode() for i in ids]
        for i in ids:
            if sp.is_control(i):
                self.surface[i] = b""
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        self.kind = "<i2" if len(ids) <= 2**15 else "<i4"
        self.code = "h" if self.kind == "<i2" else "i"
        self.cut = None
        if any(BLANK in p.lstrip(BLANK) for p in self.vocabulary):
            self.units = lambda text: [text] if text else []  # pieces run across blanks: one lattice per text
        elif any("\n" in p for p in self.vocabulary):
            self.units, self.cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall, "\n"
        else:
            self.units, self.cut = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n").findall, "\0\n\0"
        self.memory = Memory(self.kind)
        self.parts: dict[str, tuple[bytes, int, int]] = {}
        self.remembered = remembered
        self.ways: dict[tuple[str, int], list] = {}
        self.prefix = sp.normalize("x").startswith(BLANK)
        self.spelling = np.frombuffer(b"".join(self.surface), np.uint8)
        self.spelt_sizes = np.array([len(x) for x in self.surface], np.int64)
        self.spelt_firsts = np.cumsum(self.spelt_sizes) - self.spelt_sizes

    def tables(self) -> None:
        """The trie as a double array: a child of the node in cell ``c`` by symbol ``k`` is in cell ``offset[c] + k``, and ``parent`` there is ``c``.

        Symbols are numbered from 1; 0 is any other character. ``ending`` holds cost and id of the piece that ends in
        a cell as one number, whose order is that of the costs and then the ids.
        """
        symbols = sorted({c for p in self.vocabulary for c in p})
        number = {c: k for k, c in enumerate(symbols, 1)}
        self.numbers = np.zeros(0x110000, np.int32)
        self.numbers[[ord(c) for c in symbols]] = np.arange(1, len(symbols) + 1)
        self.single = np.array([False, *(c in self.vocabulary for c in symbols)])
        self.shift = max(i for i, _ in self.vocabulary.values()).bit_length()
        self.piece_sizes = np.zeros(1 << self.shift, np.int64)
        for text, (piece, _) in self.vocabulary.items():
            self.piece_sizes[piece] = len(text)
        inner, edges = [self.trie], 0
        for children in inner:
            edges += len(children)
            inner += [below for below, _, _ in children.values() if below]
        room = 1 << (4 * edges).bit_length()
        taken, offsets, draw = bytearray(room + len(symbols) + 1), {}, random.Random(0)
        for children in sorted(inner, key=len, reverse=True):
            steps, at = [number[c] for c in children], 0
            while any(taken[at + k] for k in steps):
                at = draw.randrange(room)
            for k in steps:
                taken[at + k] = 1
            offsets[id(children)] = at
        self.root = len(taken)
        self.offset, self.parent = np.zeros(self.root + 1, np.int32), np.full(self.root + 1, -1, np.int32)
        self.ending = np.full(self.root + 1, NEVER, np.int64)
        todo = [(self.root, self.trie)]
        for cell, children in todo:
            self.offset[cell] = offsets[id(children)]
            for symbol, (below, piece, cost) in children.items():
                child = offsets[id(children)] + number[symbol]
                self.parent[child] = cell
                if piece >= 0:
                    self.ending[child] = (cost << self.shift) + piece
                if below:
                    todo.append((child, below))
        # Sums of costs over a unit must fit beside an id.
        self.fits = LONG_UNIT * max(abs(c) for _, c in self.vocabulary.values()) < NEVER >> self.shift

    def spelt(self, symbol: str) -> tuple[int, ...]:
        """Ids, last first, of a character without a piece."""
        raw = symbol.encode("utf-8", "surrogatepass")
        if all(b in self.bytes for b in raw):
            return tuple(self.bytes[b] for b in reversed(raw))
        return (self.unknown,)

    def forward(self, unit: str) -> tuple[list[int], int, list[int]]:
        """Viterbi: least cost to every place, second least to the end, and the ids of the best segmentation.

        Of equal costs the segmentation with the smaller ids, read from the end, is the best.
        """
        size, root, longest = len(unit), self.trie, self.longest
        least, second, back = [0] + [NEVER] * size, [NEVER] * (size + 1), [(0, 0)] * (size + 1)
        for i in range(size):
            base, other, children, j = least[i], second[i], root, i
            for symbol in unit[i:i + longest]:
                node = children.get(symbol)
                if node is None:
                    break
                children, piece, cost = node
                j += 1
                if piece < 0:
                    continue
                done, best = base + cost, least[j]
                if done < best:
                    least[j], back[j] = done, (piece, i)
                    second[j] = best if best < other + cost else other + cost
                elif done <= best or done < second[j]:
                    second[j] = done
                    if done == best and piece < back[j][0]:
                        back[j] = (piece, i)
            if not self.vocabulary.get(unit[i]):
                cost, best = self.unknown_cost, least[i + 1]
                if base + cost < best:
                    back[i + 1] = (-1, i)
                least[i + 1], second[i + 1] = sorted((base + cost, best, other + cost, second[i + 1]))[:2]
        ids, place = [], size
        while place:
            piece, start = back[place]
            if piece < 0:
                ids.extend(self.spelt(unit[start]))
            else:
                ids.append(piece)
            place = start
        ids.reverse()
        return least, second[size], ids

    def lattice(self, unit: str) -> list[list]:
        """Edges (start, id, cost) into every place; the id is null for a character without a piece."""
        into: list[list] = [[] for _ in range(len(unit) + 1)]
        for i in range(len(unit)):
            children, j = self.trie, i
            for symbol in unit[i:i + self.longest]:
                node = children.get(symbol)
                if node is None:
                    break
                children, piece, cost = node
                j += 1
                if piece >= 0:
                    into[j].append((i, piece, cost))
            if unit[i] not in self.vocabulary:
                into[i + 1].append((i, None, self.unknown_cost))
        return into

    def backward(self, unit: str, least: list[int], into: list[list], n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` cheapest paths of a lattice as (cost, ids), best first, by A* from the end.

        Of equal totals the newest is followed first, so every path asked for takes one pop a piece.
        """
        agenda, out, pushed = [(least[-1], 0, len(unit), 0, None)], [], 0
        while agenda:
            total, _, place, behind, path = heapq.heappop(agenda)
            if not place:
                ids = []
                while path:
                    ids.extend(reversed(path[0]))
                    path = path[1]
                out.append((total, tuple(ids)))
                if len(out) == n:
                    break
                continue
            for start, piece, cost in into[place]:
                done, pushed = behind + cost, pushed - 1
                step = self.spelt(unit[start]) if piece is None else (piece,)
                heapq.heappush(agenda, (done + least[start], pushed, start, done, (step, path)))
        return out

    def segmentations(self, unit: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` cheapest segmentations of a text as (cost, ids), the forward pass's best first."""
        found = self.ways.get((unit, n))
        if found is None:
            least, _, ids = self.forward(unit)
            best = tuple(ids)
            others = [f for f in self.backward(unit, least, self.lattice(unit), n) if f[1] != best]
            found = [(least[-1], best), *others][:n]
            if len(unit) <= LONG_UNIT:
                if len(self.ways) >= WAYS:
                    self.ways.clear()
                self.ways[unit, n] = found
        return found

    def part(self, unit: str) -> tuple[bytes, int, int]:
        found = self.parts.get(unit)
        if found is None:
            least, second, ids = self.forward(unit)
            found = (array(self.code, ids).tobytes(), least[-1], second - least[-1] if second < NEVER else NEVER)
            if len(unit) <= LONG_UNIT:
                if len(self.parts) + len(self.memory.rows) >= self.remembered:
                    self.parts.clear()
                self.parts[unit] = found
        return found

    def solved(self, unit: str) -> tuple[bytes, int, int]:
        """Ids of the best segmentation as bytes, its cost, and what the second best costs more."""
        near = self.neighbours
        cuts = [k for k in range(1, len(unit)) if unit[k - 1:k + 1] not in near]
        if not cuts:
            return self.part(unit)
        ids, costs, gaps = zip(*[self.part(unit[a:b]) for a, b in zip([0, *cuts], [*cuts, len(unit)])])
        return b"".join(ids), sum(costs), min(gaps)

    def forward_all(self, units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The passes of ``forward`` side by side: which units all of whose characters are pieces, and their ids, counts of ids, costs and gaps.

        Every unit has a cell for each of its places, the last one holds no character. ``least`` and ``second`` hold
        costs with an id behind them, in ``least`` that of the last piece; so the smaller id wins among equal costs.
        """
        shift, costs = self.shift, -1 << self.shift
        codes = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.numbers[codes]
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        known = self.single[symbols]
        known[ends] = True
        symbols[ends] = 0
        known = np.logical_and.reduceat(known, starts)
        place = np.arange(len(codes)) - np.repeat(starts, sizes + 1)
        at, cell, size = np.flatnonzero(symbols), self.root, 0
        found = [(at[:0], self.ending[:0], place[:0].astype(np.int16))]
        while len(at):
            # Symbol 0 also stands behind a unit, and no cell is a child by it.
            wanted = self.offset[cell] + symbols[at + size]
            step = np.flatnonzero(self.parent[wanted] == cell)
            at, cell, size = at[step], wanted[step], size + 1
            ending = self.ending[cell]
            whole = np.flatnonzero(ending < NEVER)
            to = at[whole] + size
            found.append((to, ending[whole], (place[to] * (LONG_UNIT + 1) + size).astype(np.int16)))
        to, ending, group = map(np.concatenate, zip(*found))
        order = np.argsort(group, kind="stable")
        to, ending = to[order], ending[order]
        stops = np.cumsum(np.bincount(group)).tolist()
        least, second = np.full((2, len(codes)), NEVER, np.int64)
        least[starts] = 0
        for number, (a, b) in enumerate(zip([0, *stops], stops)):
            if a < b:
                new, more = to[a:b], ending[a:b]
                old = new - number % (LONG_UNIT + 1)
                done, best = (least[old] & costs) + more, least[new]
                second[new] = np.minimum(np.minimum(np.maximum(done, best), second[new]), (second[old] & costs) + more)
                least[new] = np.minimum(done, best)
        starts, ends = starts[known], ends[known]
        back = least & ~costs
        last, live, begun = np.zeros(len(codes), bool), ends, starts
        while len(live):
            last[live] = True
            live = live - self.piece_sizes[back[live]]
            more = np.flatnonzero(live > begun)
            live, begun = live[more], begun[more]
        before = np.cumsum(last)
        cost, other = least[ends] >> shift, second[ends]
        gaps = np.where(other < NEVER, (other >> shift) - cost, NEVER)
        return known, back[last].astype(self.kind), before[ends] - before[starts], cost, gaps

    def meet(self, texts: list[list[str]]) -> None:
        """Solve the units of some texts that aren't remembered, all new ones together; only what is remembered changes."""
        self.rows_of(list(chain.from_iterable(texts)))

    def rows_of(self, units: list[str]) -> np.ndarray:
        """Row of every unit in the memory; those without one are solved together.

        Long units are forgotten at once, but their rows can be read until the next call.
        """
        memory = self.memory
        if len(memory.rows) + len(self.parts) >= self.remembered or memory.stored >= 8 * self.remembered:
            memory.clear()
            self.parts.clear()
        try:
            rows = np.fromiter(map(memory.rows.__getitem__, units), np.int64, len(units))
            if memory.rows.new:
                self.solve_new()
        except BaseException:
            memory.clear()
            raise
        return rows

    def solve_new(self) -> None:
        memory, new = self.memory, self.memory.rows.new
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        short = np.flatnonzero(sizes <= LONG_UNIT)
        ids, counts, costs, gaps = np.empty(0, self.kind), *np.zeros((3, len(new)), np.int64)
        alone = np.ones(len(new), bool)
        if len(short) >= FEWEST and self.fits:
            known, ids, *values = self.forward_all(new if len(short) == len(new) else [new[k] for k in short.tolist()], sizes[short])
            short = short[known]
            counts[short], costs[short], gaps[short] = values
            alone[short] = False
        alone = np.flatnonzero(alone).tolist()
        if alone:
            others = [self.solved(new[k]) for k in alone]
            runs = [np.frombuffer(found[0], self.kind) for found in others]
            firsts = np.cumsum(counts) - counts
            counts[alone], costs[alone], gaps[alone] = list(map(len, runs)), [f[1] for f in others], [f[2] for f in others]
            firsts[alone] = len(ids) + np.cumsum(counts[alone]) - counts[alone]
            ids = gathered(np.concatenate([ids, *runs]), firsts, counts)
        memory.add(ids, counts, costs, gaps)
        if len(short) < len(new):
            for unit in new:
                if len(unit) > LONG_UNIT:
                    del memory.rows[unit]

    def split(self, text: str) -> list[str]:
        """The units of a text."""
        text = self.processor.normalize(text)
        if self.cut is None or "\0" in text:
            return self.units(text)
        text, apart = text.replace(BLANK, "\0" + BLANK).replace("\n", self.cut), f"{BLANK}\0{BLANK}"
        while apart in text:
            text = text.replace(apart, BLANK * 2)
        return list(filter(None, text.split("\0")))

    def encode(self, text: str, n: int = NBEST) -> tuple[bytes, int, list[tuple[int, list[tuple[int, int, tuple]]]]]:
        """Best ids (packed), their cost, and up to ``n - 1`` further segmentations.

        Each of these is its cost and the edits that turn the best ids into its own: (first piece, pieces removed, ids put there).
        """
        return self.encode_units(self.split(text), n)

    def encode_units(self, units: list[str], n: int = NBEST) -> tuple[bytes, int, list[tuple[int, list[tuple[int, int, tuple]]]]]:
        """``encode`` of a text's units."""
        ids, _, costs, others = self.encode_all([units], n)
        return ids.tobytes(), costs[0], others[0]

    def encode_all(self, texts: list[list[str]], n: int = NBEST) -> tuple[np.ndarray, np.ndarray, list[int], list[list]]:
        """``encode`` of the units of some texts: all ids, how many each text has, costs, and further segmentations."""
        units, memory, found = list(chain.from_iterable(texts)), self.memory, []
        for k in range(0, len(units), TOGETHER):
            rows = self.rows_of(units[k:k + TOGETHER])
            counts = memory.counts[rows].astype(np.int64)
            found.append((gathered(memory.ids, memory.firsts[rows], counts), counts, memory.costs[rows], memory.gaps[rows]))
        if not found:
            return np.empty(0, self.kind), np.zeros(len(texts), np.int64), [0] * len(texts), [[] for _ in texts]
        ids, counts, costs, gaps = map(np.concatenate, zip(*found))
        limits = np.cumsum([0, *map(len, texts)])
        stops, sums = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(costs)])
        totals = np.diff(sums[limits]).tolist()
        listed = limits.tolist()
        others = [self.others(units, cost, counts[a:b], stops[a:b], gaps[a:b], n) if b > a and n > 1 else []
                  for units, cost, a, b in zip(texts, totals, listed, listed[1:])]
        return ids, np.diff(stops[limits]), totals, others

    def others(self, units: list[str], cost: int, counts: np.ndarray, firsts: np.ndarray, gaps: np.ndarray, n: int) -> list[tuple[int, list]]:
        """Further segmentations of a text, from its units' pieces and gaps."""
        if len(gaps) >= n:
            limit = np.partition(gaps, n - 2)[n - 2]
            near = np.flatnonzero(gaps <= limit)
            near = near[np.argsort(gaps[near], kind="stable")][:n - 1]
        else:
            near = np.arange(len(gaps))
        places = sorted(near[gaps[near] < NEVER].tolist())
        ways = [self.segmentations(units[place], n) for place in places]
        best: list[tuple[int, tuple]] = [(0, ())]
        for found in ways:
            best = heapq.nsmallest(n, [(c + w[0] - found[0][0], (*taken, k)) for c, taken in best for k, w in enumerate(found)])
        return [(cost + more, [(int(firsts[place] - firsts[0]), int(counts[place]), found[k][1])
                               for place, found, k in zip(places, ways, taken) if k]) for more, taken in best[1:]]

    def decoded_as(self, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> list[bool]:
        """Whether every text is what its ids decode to; where bytes differ, ``decode`` has the last word."""
        sizes = self.spelt_sizes[ids]
        raw = gathered(self.spelling, self.spelt_firsts[ids], sizes).tobytes()
        stops = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(sizes)])[stops].tolist()
        same = []
        for text, a, b, first, last in zip(texts, ends, ends[1:], stops.tolist(), stops[1:].tolist()):
            if self.prefix and raw[a:a + 1] == b" " and a < b:
                a += 1
            same.append(raw[a:b] == text.encode("utf-8", "surrogatepass") or self.decode(ids[first:last].tolist()) == text)
        return same

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def edited(best: list[int], edits: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """Ids of an alternative: the best ids with the edits made."""
    out, at = [], 0
    for first, removed, put in edits:
        out += [*best[at:first], *put]
        at = first + removed
    return out + list(best[at:])


def in_runs(texts: list[str], chars: int = CHARS) -> Iterator[list[str]]:
    """Runs of consecutive texts of about so many characters."""
    start = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield texts[start:k]
            start, held = k, 0
        held += len(text)
    yield texts[start:]


@once_per_worker
def model_of(path: str, remembered: int = CACHE) -> PieceModel:
    """The model, loaded once per worker process."""
    return PieceModel(path, remembered=remembered)


def encode(docs: DataFrame, model: str, nbest: int = NBEST, doc_id: str = "doc_id", text: str = "text",
           remembered: int = CACHE) -> DataFrame:
    """``doc_id, ids, n_pieces, score, alternatives, round_trip`` per row.

    ``score`` is minus the cost in units of one. ``alternatives`` holds, from the second best on, ``(score, n_pieces,
    edits)``; an edit ``(first, removed, ids)`` says what stands in place of some of the best ids (see ``edited``).
    ``round_trip`` says whether decoding ``ids`` gives the text. ``remembered`` bounds a worker's memory of units: it
    trades memory for time and changes no result.
    """
    ship_package(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(model_of)
        loaded = model_of(model, remembered)
        for batch in texts_of(batches):
            given = [t or "" for t in batch.column(1).to_pylist()]
            values, counts, costs, more, same = [], [], [], [], []
            for some in in_runs(given):
                ids, n_pieces, cost, others = loaded.encode_all(list(map(loaded.split, some)), nbest)
                values.append(ids.astype(np.int32))
                counts.append(n_pieces)
                costs += cost
                more += others
                same += loaded.decoded_as(some, ids, n_pieces)
            counts = np.concatenate(counts)
            alternatives = [[{"score": -cost / 1e6, "n_pieces": n + sum(len(e[2]) - e[1] for e in edits),
                              "edits": [{"first": e[0], "removed": e[1], "ids": list(e[2])} for e in edits]}
                             for cost, edits in others] for n, others in zip(counts.tolist(), more)]
            yield pa.record_batch([
                batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.concatenate(values))),
                pa.array(counts, pa.int64()), pa.array([-c / 1e6 if c else 0.0 for c in costs], pa.float64()),
                pa.array(alternatives, ALTERNATIVES), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "n_pieces", "score", "alternatives", "round_trip"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        encoded, f"doc_id {kind}, ids array<int>, n_pieces long, score double, alternatives array<struct<score: double, "
                 "n_pieces: long, edits: array<struct<first: int, removed: int, ids: array<int>>>>>, round_trip boolean")


def decode(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` of the id lists; a null list gives a null text."""
    ship_package(encoded.sparkSession)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = model_of(model)
        for batch in texts_of(batches):
            texts = [None if i is None else loaded.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(
        decoded, f"doc_id {kind}, text string")
