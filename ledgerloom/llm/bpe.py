"""Byte-level BPE by a lazily determinised transducer, and decoding as a stream.

A file of ranks is compiled into a trie of its tokens. A nondeterministic transducer reads bytes, walks the trie, and may
close a token where the trie has one that *fits* the token before it: merging the two by rank alone would leave just
these two. A sequence of tokens of which each fits its predecessor is what the merges make of its bytes, so one path of the
transducer is right, and every prefix of the input has exactly one path that closes a token at its end.

Determinised, a state is the set of paths still open: the last closed token, the node in the trie, and the tokens that are
closed but not yet certain. What all open paths share is emitted; as an open path lies within one token of the input's
end, a token leaves after a lookahead of at most the longest token. States and transitions are made when first needed and
forgotten all together when there are ``STATES`` of them. Pre-tokens are found by the given pattern and each distinct one
that is remembered is not read again; a pre-token is one run of the transducer, whatever its length.

Decoding looks up the bytes of each id and gives text as it comes: a state machine over the last bytes of a chunk holds
back an unfinished character; bytes that are no UTF-8 become U+FFFD, as when the whole is decoded at once.

The pattern must not match from a character that is no white space on into white space, so that a text can be cut where a
run of white space starts. Ranks must be those of merges: every single byte has one, and a token's halves rank before it.

Defined cases: a null text is an empty one and has no ids; null ids and repeated rows stay rows of their own; an empty table
gives an empty one; an id outside the vocabulary raises. Extra columns are never looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship_package, texts_of
from ledgerloom.llm.token_files import SPACES

#: States of the transducer, and pre-tokens with their ids, that a worker remembers; a full memory is emptied.
STATES, REMEMBERED, LONG_UNIT = 250_000, 600_000, 64
#: Ids that are decoded together.
CHUNK = 8192
ROOT, START, NEVER = 0, -1, 1 << 62


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of their ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("the ranks lack a single byte")
    return tokens


class Merges:
    """What the ranks say about two tokens side by side."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.rank = tokens, {t: r for r, t in enumerate(tokens)}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.known: dict[int, bool] = {}

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a byte. Raises for a token that merges never make."""
        if rank not in self.halves:
            token, get = self.tokens[rank], self.rank.get
            parts = [token[i:i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min((get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best >= rank:
                    raise ValueError(f"rank {rank} is not made by merges of lower ranks")
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.halves[rank] = (get(parts[0]), get(parts[1])) if len(parts) == 2 else None
            if any(len(self.tokens[t]) > 1 and t >= rank for t in self.halves[rank] or ()):
                raise ValueError(f"rank {rank} comes before its halves")
        return self.halves[rank]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together merge into just these two.

        Seen backwards in time, the two tokens at the border are halved, the one that was merged last first (of equal ranks
        the right one, as merges go from left to right). The border is crossed if at any time the two tokens beside it have a
        rank before that of the merge that consumes one of them.
        """
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            known = self.known[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        tokens, get = self.tokens, self.rank.get
        left_ends = right_ends = NEVER
        while True:
            crossing = get(tokens[left] + tokens[right])
            if crossing is not None and crossing < left_ends and crossing <= right_ends:
                return False
            one, two = len(tokens[left]) > 1, len(tokens[right]) > 1
            if one and (not two or left > right):
                left_ends, left = left, self.split(left)[1]
            elif two:
                right_ends, right = right, self.split(right)[0]
            else:
                return True


class Transducer:
    """Tokens of byte strings, by states that are made when first needed."""

    def __init__(self, tokens: list[bytes], states: int = STATES):
        self.merges, self.limit = Merges(tokens), states
        self.step: dict[int, int] = {}  # node and byte -> node
        self.closes, self.grows = [-1], [True]
        for rank, token in enumerate(tokens):
            node = ROOT
            for byte in token:
                after = self.step.get(node << 8 | byte)
                if after is None:
                    after = self.step[node << 8 | byte] = len(self.closes)
                    self.closes.append(-1)
                    self.grows.append(False)
                    self.grows[node] = True
                node = after
            self.closes[node] = rank
        self.forget()

    def forget(self) -> None:
        start = ((START, ROOT, ()),)
        self.paths, self.number, self.table = [start], {start: 0}, {}

    def advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after a byte and the tokens that have become certain; remembered."""
        step, grows, closes, fits = self.step, self.grows, self.closes, self.merges.fits
        open_paths, closed = [], None
        for before, node, held in self.paths[state]:
            after = step.get(node << 8 | byte)
            if after is None:
                continue
            token = closes[after]
            if closed is None and token >= 0 and (before < 0 or fits(before, token)):
                closed = (token, ROOT, (*held, token))
            if grows[after]:
                open_paths.append((before, after, held))
        if closed is None:
            raise ValueError("the ranks are not those of merges")
        open_paths.append(closed)
        certain = open_paths[0][2]
        for _, _, held in open_paths[1:]:
            if not certain:
                break
            same = 0
            for a, b in zip(certain, held):
                if a != b:
                    break
                same += 1
            certain = certain[:same]
        if certain:
            same = len(certain)
            open_paths = [(before, node, held[same:]) for before, node, held in open_paths]
        paths = tuple(open_paths)
        after = self.number.get(paths)
        if after is None:
            after = self.number[paths] = len(self.paths)
            self.paths.append(paths)
        out = self.table[state << 8 | byte] = (after, certain)
        return out

    def encode(self, given: bytes) -> list[int]:
        if len(self.paths) > self.limit:
            self.forget()
        if len(self.merges.known) > 4 * self.limit:
            self.merges.known.clear()
        out: list[int] = []
        state, table = 0, self.table
        for byte in given:
            found = table.get(state << 8 | byte)
            state, certain = found or self.advance(state, byte)
            if certain:
                out += certain
            if state > self.limit + 4096:  # one long input
                paths = self.paths[state]
                self.forget()
                table = self.table
                self.number[paths], state = 1, 1
                self.paths.append(paths)
        if given:
            out += self.paths[state][-1][2]  # the path that closes a token here is the last one
        return out


@functools.cache
def text_encoder(path: str, pattern: str, states: int = STATES, remembered: int = REMEMBERED) -> Callable[[str], bytes]:
    """Ids of a text as little-endian unsigned 32-bit integers; one per worker process, kept from task to task."""
    import re

    import regex

    transducer = Transducer(read_ranks(path), states)
    units = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
    pieces = regex.compile(pattern).findall
    memory: dict[str, bytes] = {}

    def keep(unit: str, ids: bytes) -> bytes:
        if len(unit) <= LONG_UNIT:
            if len(memory) >= remembered:
                memory.clear()
            memory[unit] = ids
        return ids

    def piece_ids(piece: str) -> bytes:
        return memory.get(piece) or keep(piece, array("I", transducer.encode(piece.encode())).tobytes())

    def unit_ids(unit: str) -> bytes:
        ids = memory.get(unit)
        if ids is None:
            parts = pieces(unit)
            ids = piece_ids(unit) if len(parts) == 1 else keep(unit, b"".join(map(piece_ids, parts)))
        return ids

    def encode(text: str) -> bytes:
        found = units(text)
        try:
            return b"".join([memory[u] for u in found])
        except KeyError:
            return b"".join(map(unit_ids, found))

    return encode


#: The bytes that may follow a lead byte of UTF-8 (first and last second byte), and how many follow in all.
LEADS = [(range(0xC2, 0xE0), 0x80, 0xBF, 1), (range(0xE0, 0xE1), 0xA0, 0xBF, 2), (range(0xE1, 0xED), 0x80, 0xBF, 2),
         (range(0xED, 0xEE), 0x80, 0x9F, 2), (range(0xEE, 0xF0), 0x80, 0xBF, 2), (range(0xF0, 0xF1), 0x90, 0xBF, 3),
         (range(0xF1, 0xF4), 0x80, 0xBF, 3), (range(0xF4, 0xF5), 0x80, 0x8F, 3)]


class Utf8Reader:
    """Text from bytes that come in chunks cut anywhere.

    The machine's state is what the next byte may be (``low`` to ``high``) and how many bytes a character still lacks. Only a
    chunk's last three bytes can leave a character open, so it runs over these.
    """

    def __init__(self):
        self.open = b""
        self.after = {lead: (low, high, more) for leads, low, high, more in LEADS for lead in leads}

    def unfinished(self, chunk: bytes) -> int:
        """Length of the start of a character at the end of the chunk."""
        for back in range(1, min(3, len(chunk)) + 1):
            state = self.after.get(chunk[-back])
            if state is None:
                continue
            low, high, more = state
            for byte in chunk[len(chunk) - back + 1:]:
                if not low <= byte <= high:
                    return 0
                low, high, more = 0x80, 0xBF, more - 1
            return back if more else 0
        return 0

    def feed(self, chunk: bytes) -> str:
        chunk = self.open + chunk
        ready = len(chunk) - self.unfinished(chunk)
        self.open = chunk[ready:]
        return chunk[:ready].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open.decode("utf-8", "replace"), b""
        return rest


@functools.cache
def vocabulary(path: str) -> list[bytes]:
    return read_ranks(path)


def decoded(ids: np.ndarray, tokens: list[bytes], chunk: int = CHUNK) -> Iterator[tuple[bytes, str]]:
    """The bytes of each run of ids, and the text that is complete with them; the last text closes the stream."""
    reader = Utf8Reader()
    for start in range(0, len(ids), chunk):
        part = b"".join([tokens[i] for i in ids[start:start + chunk].tolist()])
        yield part, reader.feed(part)
    yield b"", reader.close()


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of long) per row."""
    ship_package(docs.sparkSession)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for batch in texts_of(batches):
            ids = [np.frombuffer(encoder(t or ""), "<u4").astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        ids_of, "doc_id long, ids array<long>")


def decode(rows: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` per row of ids; null ids are an empty text."""
    ship_package(rows.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path)
        for batch in texts_of(batches):
            out = ["".join(piece for _, piece in decoded(np.array(row or [], np.int64), tokens)) for row in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(texts, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its number of ids, and digests of the ids and of the bytes that decoding them gives, in one pass."""
    ship_package(docs.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = text_encoder(path, pattern), vocabulary(path)
        for batch in texts_of(batches):
            counts, ids_sha, text_sha, whole = [], [], [], []
            for given in batch.column(1).to_pylist():
                ids, back, same = encoder(given or ""), hashlib.sha256(), []
                numbers = np.frombuffer(ids, "<u4")
                for part, piece in decoded(numbers, tokens):
                    back.update(part)
                    same.append(piece)
                counts.append(len(numbers))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(back.hexdigest())
                whole.append("".join(same) == (given or ""))
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                                   pa.array(text_sha, pa.string()), pa.array(whole, pa.bool_())],
                                  ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same_text"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean")
