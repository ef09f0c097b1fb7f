"""Line dedup, SimHash, language ID, token files, pieces: brute force on small tables, odd rows, empty tables."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from ledgerloom.llm import common, language, lines, pieces, similar, simhash, token_files
from ledgerloom.llm.common import fresh_dir, read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_line_dedup_keeps_first_run_and_short_repeats(docs_of):
    block = "\n".join(" ".join(f"a{i}b{j}" for j in range(20)) for i in range(4))
    rows = [(3, f"head\n{block}\nlicence line"), (1, f"{block}\nlicence line"), (2, "licence line\n\nown words"),
            (4, "\n".join(["same words " * 10] * 8))]
    got = {r.doc_id: r.text for r in lines.line_report(docs_of(rows)).collect()}
    assert got[1] == rows[1][1] and got[2] == rows[2][1]
    assert got[3] == "head\nlicence line" or got[3] == "head"
    assert got[4] == "same words " * 10


def maximal_lines(rows, least=50):
    """(id, text) in order -> kept text, by extending every equal pair of places line by line."""
    places, out, full_lines = {}, [], []
    for _, text in rows:
        parts = (text or "").split("\n")
        full_lines.append([(i, p, len(WORD.findall(p))) for i, p in enumerate(parts) if WORD.search(p)])
    for number, (_, text) in enumerate(rows):
        mine, gone = full_lines[number], set()
        for a, (_, line, _) in enumerate(mine):
            for other, b in places.get(line, []):
                theirs, n, words = full_lines[other], 0, 0
                if a and b and mine[a - 1][1] == theirs[b - 1][1]:
                    continue  # not the run's first line
                while a + n < len(mine) and b + n < len(theirs) and mine[a + n][1] == theirs[b + n][1]:
                    words += mine[a + n][2]
                    n += 1
                if words >= least:
                    gone |= {mine[k][0] for k in range(a, a + n)}
            places.setdefault(line, []).append((number, a))
        out.append(text if text is None else "\n".join(p for i, p in enumerate(text.split("\n")) if i not in gone))
    return out


def test_line_dedup_deletes_maximal_runs(spark, docs_of):
    long, short = [" ".join(f"{c}{j}" for j in range(30)) for c in "xy"], " ".join(f"z{j}" for j in range(10))
    rows = [(1, "\n".join([*long, short, "own end " * 60])), (2, "\n".join(["head", *long, "", short, "other end " * 60])),
            (3, "\n".join([*long, "third"])), (4, "\n".join([*long, short]))]
    got = {r.doc_id: r.text for r in lines.line_report(docs_of(rows)).collect()}
    assert got[1] == rows[0][1] and got[3] == "third" and got[4] == ""
    assert got[2] == "head\n\n" + "other end " * 60
    block = "\n".join(" ".join(f"a{i}b{j}" for j in range(20)) for i in range(4))
    tail = lines.line_report(docs_of([(3, f"head\n{block}\nlicence line"), (1, f"{block}\nlicence line")])).collect()
    assert {r.doc_id: r.text for r in tail}[3] == "head"
    docs = read(spark, SMALL, "documents")
    given = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    found = {r.doc_id: r for r in lines.line_report(docs).collect()}
    assert [found[d].text for d, _ in given] == maximal_lines(given)
    assert sum(r.n_removed for r in found.values()) > 0


def test_line_dedup_odd_rows(docs_of, odd_rows):
    got = lines.line_report(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert by_id[4] == [None] and by_id[3] == [""] and by_id[8] == [" \n\t "]
    assert by_id[1] == [odd_rows[0][1]] and by_id[2] == ["", ""]  # rows equal in id and text are one document
    assert sorted(map(str, by_id[None])) == ["", "None"]
    assert len(by_id[5]) == 2 and by_id[6] == [odd_rows[9][1]]
    kept = lines.without_repeats(docs_of(odd_rows))
    assert kept.columns == docs_of(odd_rows).columns
    assert lines.line_report(docs_of([])).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs_of, odd_rows):
    base = passage = [f"tok{i}" for i in range(400)]
    near = [(100 + k, " ".join(passage[:k * 9] + [f"new{k}"] + base[k * 9 + 1:])) for k in range(20)]
    rows = [*odd_rows, *near]
    got = simhash.near_groups(docs_of(rows)).collect()
    marks = [plain_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if bin(marks[a] ^ marks[b]).count("1") <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[group[k]] = min(least.get(group[k], r[0]), r[0])
    expected = sorted((str(r[0]), f"{m:016x}", str(least.get(g))) for r, m, g in zip(rows, marks, group))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected
    assert len(set(group[len(odd_rows):])) < len(near)  # some of the edits stay within the radius
    kept = simhash.keep_one(docs_of(rows))
    assert kept.count() == len(set(group)) and kept.columns == docs_of(rows).columns
    assert simhash.near_groups(docs_of([])).count() == 0


def test_near_copies_at_08_are_found(docs_of, odd_rows):
    rng, rows = np.random.default_rng(7), list(odd_rows)
    for k in range(60):  # 200 words: four edits far apart leave 176 of 216 shingles, five 171 of 221
        words = [f"w{v}" for v in rng.integers(0, 5000, 200)]
        near = [f"new{k}" if i in (20, 60, 100, 140) else w for i, w in enumerate(words)]
        far = [f"old{k}" if i in (10, 50, 90, 130, 170) else w for i, w in enumerate(words)]
        rows += [(100 + k, " ".join(words)), (200 + k, " ".join(near)), (300 + k, " ".join(far))]
    hub = [f"h{i}" for i in range(400)]
    rows += [(1000 + k, " ".join(f"edit{k}" if i in (k, 200 + k) else w for i, w in enumerate(hub))) for k in range(150)]
    kept = {r.doc_id for r in similar.keep_one(docs_of(rows)).collect()}
    assert {100 + k for k in range(60)} | {300 + k for k in range(60)} <= kept
    assert not kept & {200 + k for k in range(60)}
    assert {3, 1, 5, 6, 9, 10, 11} <= kept and not kept & {2, 7, 8}  # 4 and 8 have no words, as 3; 7 is 6 and one word
    assert kept & set(range(1000, 1150)) == {1000}
    assert similar.keep_one(docs_of([])).count() == 0


def test_wide_bit_planes_equal_popcounts():
    rng = np.random.default_rng(8)
    marks = rng.integers(0, 2**63, (150, 2), dtype=np.uint64)
    marks = np.concatenate([marks, marks ^ (rng.integers(0, 2**63, (150, 2), dtype=np.uint64) & rng.integers(0, 2**63, (150, 2), dtype=np.uint64))])
    count = np.bitwise_count(marks[:200, None] ^ marks[None]).sum(axis=2)
    for radius in (0, 3, 31, 32, 36, 64, 127):
        query, lane = similar.within(marks[:200], marks, radius)
        found = np.zeros((200, len(marks)), bool)
        found[query, lane] = True
        assert len(query) == found.sum() and (found == (count <= radius)).all()


def test_parities_bound_the_difference():
    rng = np.random.default_rng(9)
    for size in (5, 80, 700, 6000):
        for share in (0.8, 0.85, 0.99):
            hashes = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            other = round(size * (1 - share) / (1 + share))  # of each set alone, so that similarity is at least the share
            one, two = hashes[:size], np.concatenate([hashes[other:size], hashes[size:size + other]])
            bits = np.frombuffer(similar.parity(one) + similar.parity(two), np.uint64).reshape(2, -1)
            differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert differ <= 2 * other


def test_unlike_texts_within_the_radius_stay_in_their_cell():
    import tracemalloc

    rng, n = np.random.default_rng(10), 8000
    hashes = rng.integers(0, 2**63, (n, 120), dtype=np.uint64)
    bits = np.frombuffer(b"".join(similar.parity(h) for h in hashes), np.uint64).reshape(n, -1)
    members = np.stack([np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, 120), np.arange(n)], axis=1)
    members[1, 3] = 119
    bits = bits.copy()
    bits[1] = bits[0]  # the only pair that may be alike
    tracemalloc.start()
    found = [pair for pair in similar.proposed(members, bits, True, 1, similar.RADIUS, similar.LEAST)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [sorted((int(a), int(b))) for x, y in found for a, b in zip(x, y)] == [[0, 1]]
    assert peak < 400e6


def test_bit_planes_equal_popcounts():
    rng = np.random.default_rng(5)
    marks = rng.integers(0, 2**63, 300, dtype=np.uint64)
    marks = np.concatenate([marks, *(marks ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64)) for _ in range(4))])
    for radius in range(4):
        q, lane = simhash.near(marks[:700], marks, radius)
        a, b = np.nonzero(np.bitwise_count(marks[:700, None] ^ marks[None]) <= radius)
        assert sorted(zip(q.tolist(), lane.tolist())) == sorted(zip(a.tolist(), b.tolist()))


def test_hot_key_is_cut_into_cells(spark):
    rng = np.random.default_rng(6)
    marks = {int(0x1234 << 40) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 30, (300, 2))}
    frame = spark.createDataFrame([(m,) for m in marks], "fp long")
    from ledgerloom.llm.graph import components

    for cell in (16, 8192):
        roots = components(simhash.links(frame, cell=cell)).collect()
        assert len({r.root for r in roots}) == 1 and len({r.node for r in roots}) == len(marks)


def plain_phrases(text, sample):
    count = 0
    for start in range(0, len(text), language.WINDOW):
        window, at = text[start:start + language.WINDOW], 0
        while at < len(window):
            end = at + 1
            while end < len(window) and window[at:end + 1] in sample:
                end += 1
            count, at = count + 1, end
    return count


def test_phrases_equal_brute_force():
    samples = (("a", "the cat sat on the mat and the hat"), ("b", "der hut und die katze auf der matte"))
    parser = language.Parser(samples)
    texts = ["the hat on the cat", "die matte", "zzz the", "Öl und Hut! 12", "the cat " * 400]
    counts = parser.phrases([parser.encode(t) for t in texts])
    for text, row in zip(texts, counts):
        clean = re.sub(" +", " ", language.symbols(text)).lstrip()
        assert row.tolist() == [plain_phrases(clean, s) for _, s in samples]


def test_language_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(docs_of, odd_rows):
    got = language.identify(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    named = {(r.doc_id, r.lang_pred) for r in got}
    assert {(4, "und"), (3, "und"), (8, "und"), (11, "und"), (None, "und")} <= named
    assert language.identify(docs_of([])).count() == 0
    assert {r.lang_pred for r in language.identify(docs_of([(1, "no label here")])).collect()} == {"und"}
    kept = language.keep_known(docs_of([*odd_rows, (12, "日本語の文字だけ", None)]))
    assert {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 8, 11, 12}) and kept.columns == docs_of([]).columns


def test_labels_with_hardly_any_letters(docs_of, spark):
    docs = read(spark, SMALL, "documents").select("doc_id", "text", "lang")
    odd = [(10**6 + k, t, lang) for k, (t, lang) in enumerate([("12 34", "zxx"), ("", "zxx"), ("...", "zxx"), ("a", "tiny"), ("e 5", "tiny")] * 8)]
    mixed = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    assert "zxx" not in dict(language.samples(mixed))
    want = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    got = {r.doc_id: r.lang_pred for r in language.identify(mixed).collect()}
    long = {r.doc_id for r in docs.collect() if len(r.text or "") >= 50}
    assert all(got[d] == want[d] for d in long) and len(long) > 100
    before, after = (language.keep_known(d).filter("length(text) >= 50 and doc_id < 1000000").count() for d in (docs, mixed))
    assert after == before > 100


def test_token_files_equal_direct_encoding(spark, docs_of, odd_rows):
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(BPE)
    spaces = ["a  b", "x \n y", "don't we'll", "　x  y", "a\x1c\x1db !", "  lead", "trail  ", "<|endoftext|> hi", "\x85x"]
    rows = [*odd_rows, *[(50 + k, t) for k, t in enumerate(spaces)]]
    folder = fresh_dir(spark, "tokens-test")
    index = token_files.write_token_files(docs_of(rows), folder, BPE, shards=3)
    got = token_files.read_token_files(spark, folder, with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    ids = {t: [*direct.encode(t, add_special_tokens=False).ids, 2] for t in {r[1] or "" for r in rows}}
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda d: (d is None, d or 0))
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(r[0]), ids[r[1] or ""]) for r in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert index["dtype"] == "<u2" and sum(s["tokens"] for s in index["shards"]) == at
    assert token_files.token_file_report(spark, docs_of([]), BPE).count() == 0


def test_token_files_keep_added_tokens(spark, docs_of):
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(BPE)
    rows = [(1, "a<|endoftext|>b"), (2, "<|endoftext|> hi  <|endoftext|>\n"), (3, "x <|endof text|> y"), (4, "plain words")]
    folder = fresh_dir(spark, "tokens-added")
    token_files.write_token_files(docs_of(rows), folder, BPE, end_id=None, shards=2)
    got = {r.doc_id: r.ids for r in token_files.read_token_files(spark, folder, with_ids=True).collect()}
    assert got == {d: direct.encode(t, add_special_tokens=False).ids for d, t in rows}
    assert got[1] == [64, 50256, 65]


def test_units_are_cut_and_spelt_without_slow_steps(monkeypatch):
    """Ids are the tokenizer's for words with marks and for all bytes, and a word with a mark needs no pattern of pieces."""
    import regex
    import tokenizers

    draw = random.Random(7)
    ends = ["", ",", ".", "!", "?", ";", ":", "'s", "'", "12", "!?", ".,", "\xad", "\u3000", "𝔘", "\x00", "³"]
    words = ["e", "n", "ß", "ö", "日", "Я", "ing", "the", "que", "é", "\x7f", "\xa1"]
    texts = ["".join(draw.choice([" ", " ", "\n", "  ", ""]) + "".join(draw.choices(words, k=draw.randrange(5))) + draw.choice(ends)
                     for _ in range(draw.randrange(40))) for _ in range(400)]
    texts += ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x3000, 64)] + [".", " .", "'", " ,"]
    direct = tokenizers.Tokenizer.from_file(BPE)
    token_files.bpe_encoder.cache_clear()
    encode = token_files.bpe_encoder(BPE, None)
    for _ in range(2):
        assert [np.frombuffer(encode(t), "<u2").tolist() for t in texts] == [
            direct.encode(t, add_special_tokens=False).ids for t in texts]

    class NoPattern:
        findall = None

    monkeypatch.setattr(regex, "compile", lambda pattern: NoPattern)
    token_files.bpe_encoder.cache_clear()
    plain = "the cat, sat. Where? Öde; so: no!"
    assert np.frombuffer(token_files.bpe_encoder(BPE, None)(plain), "<u2").tolist() == direct.encode(plain).ids
    token_files.bpe_encoder.cache_clear()


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PIECES)


def all_segmentations(model, text):
    text, out = model.processor.normalize(text), []

    def go(at, cost, path):
        if at == len(text):
            out.append((cost, path))
            return
        if text[at] not in model.vocabulary:
            go(at + 1, cost + model.unknown_cost, path + model.spelt(text[at])[::-1])
        for end in range(at + 1, min(len(text), at + model.longest) + 1):
            if text[at:end] in model.vocabulary:
                piece, more = model.vocabulary[text[at:end]]
                go(end, cost + more, (*path, piece))

    go(0, 0, ())
    return sorted(out, key=lambda s: s[0])


@pytest.mark.parametrize("text", ["the cat", "a  b", "x\ny", "Öde ß", "日x\x01", "aaaa", "hi\n\n hi", " a", "𝔘 x"])
def test_nbest_equals_all_segmentations(model, text):
    every = all_segmentations(model, text)
    packed, cost, others = model.encode(text, 6)
    best = np.frombuffer(packed, model.kind).tolist()
    found = [(cost, best)] + [(c, pieces.edited(best, e)) for c, e in others]
    assert [c for c, _ in found] == [c for c, _ in every[:6]]
    costs = dict((p, c) for c, p in every)
    assert all(costs[tuple(p)] == c for c, p in found) and len({tuple(p) for _, p in found}) == len(found)
    assert model.decode(best) == text


def test_new_parts_of_a_batch_are_solved_together(model, monkeypatch):
    """The pass over arrays gives what the pass over one part gives, and parts of known characters need no pass of their own."""
    draw, known = random.Random(5), sorted(model.vocabulary)
    single = [p for p in known if len(p) == 1]
    texts = ["".join(draw.choices(known, k=draw.randrange(9))) for _ in range(400)]
    texts += ["".join(draw.choices([*single, " ", "\n", "\x01", "𝔘"], k=draw.randrange(60))) for _ in range(400)]
    texts += ["a" * k for k in range(60)] + ["abc " * k for k in range(20)] + ["日" * k for k in range(5)]
    alone, together = pieces.PieceModel(PIECES), pieces.PieceModel(PIECES, remembered=2_000)
    wanted = [alone.encode(t) for t in texts]
    assert [t for run in pieces.in_runs(texts, 500) for t in run] == texts
    got = []
    for some in pieces.in_runs(texts, 20_000):
        units = list(map(together.split, some))
        together.meet(units)
        got += [together.encode_units(u) for u in units]
    assert got == wanted
    fresh = pieces.PieceModel(PIECES)
    monkeypatch.setattr(fresh, "forward", None)
    words = [[f"▁{a}{b}" for a in ("new", "der", "que", "the") for b in ("ing", "keit", "ción", "ment", "eaux", "ström", "ll", "xq", "zz")]]
    fresh.meet(words)
    assert all(fresh.memory[w] == alone.solved(w) for w in words[0])


def test_units_of_a_batch_are_looked_up_and_solved_over_arrays(model, monkeypatch):
    """Every distinct unit of known characters is solved once and in no pass of its own; others, long units and forgetting change no result."""
    draw, single = random.Random(6), [p for p in sorted(model.vocabulary) if len(p) == 1]
    words = ["".join(draw.choices("abcdefghijklmnoprstuéß,.", k=draw.randrange(1, 12))) for _ in range(500)]
    plain = [" ".join(draw.choices(words, k=draw.randrange(60))) for _ in range(80)]
    odd = ["".join(draw.choices([*single, " ", "\n", "\x00", "\x01", "𝔘", "▁", "日本"], k=draw.randrange(90))) for _ in range(300)]
    odd += ["", "▁", "\x00", "日" * 40, "".join(draw.choices(single, k=500)), "𝔘 " * 50, "a  b \n\n   c ", *(" " * k for k in range(9))]

    def rows(model, texts):
        ids, counts, costs, others = model.encode_all(list(map(model.split, texts)))
        assert model.decoded_as(texts, ids, counts) == [model.decode(i.tolist()) == t for i, t in zip(np.split(ids, np.cumsum(counts)[:-1]), texts)]
        return [(i.tobytes(), c, o) for i, c, o in zip(np.split(ids, np.cumsum(counts)[:-1]), costs, others)]

    assert all(model.split(t) == model.units(model.processor.normalize(t)) for t in plain + odd)
    alone, together, solved = pieces.PieceModel(PIECES), pieces.PieceModel(PIECES), []
    with monkeypatch.context() as patch:
        patch.setattr(pieces, "FEWEST", 1 << 30)
        wanted = [alone.encode(t) for t in plain + odd]
    with monkeypatch.context() as patch:
        patch.setattr(together, "part", None)
        patch.setattr(together, "forward_all", lambda units, sizes, inner=together.forward_all: (solved.extend(units), inner(units, sizes))[1])
        assert rows(together, plain) + rows(together, plain) == wanted[:len(plain)] * 2
        assert sorted(solved) == sorted({u for t in plain for u in together.split(t)})
    assert rows(together, plain + odd) == wanted
    monkeypatch.setattr(pieces, "TOGETHER", 100)
    assert rows(pieces.PieceModel(PIECES, remembered=150), odd + plain) == wanted[len(plain):] + wanted[:len(plain)]


def test_pieces_odd_rows(docs_of, odd_rows):
    got = pieces.encode(docs_of(odd_rows), PIECES).collect()
    assert len(got) == len(odd_rows) and all(r.round_trip for r in got)
    assert {r.n_pieces for r in got if r.doc_id in (3, 4)} == {0}
    back = pieces.decode(pieces.encode(docs_of(odd_rows), PIECES), PIECES).collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in odd_rows)
    assert pieces.encode(docs_of([]), PIECES).count() == 0




def test_a_worker_holds_one_model_and_lets_go_of_others():
    """A worker outlives its stage: another sample replaces the automata, and another operator's task drops them."""
    language.parser_of((("en", "some words"),))
    language.parser_of((("en", "other words"), ("de", "andere")))
    assert language.parser_of.cache_info().currsize == 1
    pieces.model_of(PIECES)
    common.let_go(language.parser_of)
    assert (language.parser_of.cache_info().currsize, pieces.model_of.cache_info().currsize) == (1, 0)
    common.let_go()
    assert language.parser_of.cache_info().currsize == 0
