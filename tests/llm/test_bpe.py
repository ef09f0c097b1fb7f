"""Byte-level BPE against the tiktoken library, decoding against decoding at once; odd rows, empty tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import bpe
from ledgerloom.llm.common import read

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {t: r for r, t in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library(library):
    tokens, rng = bpe.read_ranks(RANKS), random.Random(3)
    made = bpe.Transducer(tokens, states=500)  # forgets often
    given = [bytes([b]) * n for b in range(256) for n in (1, 2, 3, 7, 33)] + [b"ab" * n for n in range(1, 60)]
    given += [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    given += [bytes(rng.choice(b"aabeinst \xc3\xa9") for _ in range(rng.choice([2, 9, 80, 6000]))) for _ in range(300)]
    for some in given:
        ids = made.encode(some)
        assert ids == library._encode_single_piece(some)
        assert b"".join(tokens[t] for t in ids) == some
    assert made.encode(b"") == []
    assert len(made.paths) <= 500 + 4096 + 6000


def test_fitting_pairs_are_what_merging_leaves(library):
    tokens, rng = bpe.read_ranks(RANKS), random.Random(4)
    merges = bpe.Merges(tokens)
    pairs = [(rng.randrange(len(tokens)), rng.randrange(len(tokens))) for _ in range(3000)]
    pairs += [(rng.randrange(1500), rng.randrange(1500)) for _ in range(3000)]
    for a, b in pairs:
        assert merges.fits(a, b) == (library._encode_single_piece(tokens[a] + tokens[b]) == [a, b])


def test_tokens_leave_after_bounded_lookahead():
    tokens = bpe.read_ranks(RANKS)
    made, state, pending = bpe.Transducer(tokens), 0, 0
    longest = max(map(len, tokens))
    for byte in b"the quick brown fox and the lazy dog " * 50:
        state, certain = made.advance(state, byte)
        pending += 1 - sum(len(tokens[t]) for t in certain)
        assert pending <= 2 * longest


def test_ranks_that_are_no_merges_are_refused(tmp_path):
    import base64

    singles = [bytes([b]) for b in range(256)]
    write = lambda tokens: (tmp_path / "r").write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for r, t in enumerate(tokens)))
    write(singles[:-1])
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "r"))
    write([*singles, b"abc"])
    with pytest.raises(ValueError):
        bpe.Merges(bpe.read_ranks(str(tmp_path / "r"))).split(256)


def test_decoding_in_chunks_equals_decoding_at_once():
    rng = random.Random(5)
    samples = ["aé漢😀\U0010FFFF".encode(), b"\xff\xc3\x28\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80\xf4\x90\x80\x80", b"\xe0\x80\xc0\xaf"]
    samples += [bytes(rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xE2, 0xED, 0xF0, 0xF4, 0x9F]) for _ in range(40)) for _ in range(300)]
    for whole in samples:
        reader, text, at = bpe.Utf8Reader(), [], 0
        while at < len(whole):
            size = rng.randint(1, 4)
            text.append(reader.feed(whole[at:at + size]))
            at += size
        assert "".join(text) + reader.close() == whole.decode("utf-8", "replace")


def test_round_trip_equals_library_on_documents(spark, library, docs_of, odd_rows):
    spaces = ["a  b", "x \n y", "don't we'll", "　x  y", "a\x1c\x1db !", "  lead", "trail  ", "<|endoftext|> hi", "\x85x", "a\xa0b", "漢字かな 😀😀"]
    docs = docs_of([*odd_rows, *[(50 + k, t) for k, t in enumerate(spaces)]])
    docs = docs.unionByName(read(spark, "/root/testdata/sf0.001", "documents"), allowMissingColumns=True)
    got = bpe.round_trip(docs, RANKS, PATTERN).collect()
    expected = []
    for row in docs.select("doc_id", "text").collect():
        text = row.text or ""
        ids = library.encode_ordinary(text)
        expected.append((str(row.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest(), True))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(expected)
    there = bpe.encode(docs, RANKS, PATTERN)
    back = bpe.decode(there.withColumn("ids", F.when(F.size("ids") > 0, F.col("ids"))), RANKS)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted(
        (str(r.doc_id), r.text or "") for r in docs.select("doc_id", "text").collect())


def test_empty_table(docs_of):
    assert bpe.round_trip(docs_of([]), RANKS, PATTERN).count() == 0
    assert bpe.decode(bpe.encode(docs_of([]), RANKS, PATTERN), RANKS).count() == 0
