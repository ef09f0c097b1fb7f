"""Search, embedding dedup, chat, mixing, sharding, pipeline: brute force on small tables, odd rows, empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import chat, mixing, projections, search, sharding
from ledgerloom.llm.common import WORD, materialise, word_count
from ledgerloom.llm.graph import components

VECTORS = "vec_id long, embedding array<float>, label int, block string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows], VECTORS)


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(0, 240)]
    rows += [(300 + i, rows[i][1]) for i in range(0, 60)]  # copies
    rows += [(400 + i, [x * 2 for x in rows[i][1]]) for i in range(5)] + [(500 + i, [x + 0.02 for x in rows[i][1]]) for i in range(20)]
    return rows + [(600, None), (650, []), (700, [0.0] * 8), (701, [None] + [1.0] * 7), (702, [float("nan")] + [1.0] * 7),
                   (703, [float("inf")] + [1.0] * 7), (750, [1.0, 2.0]), (800, [0.5, 0.5]), (None, rows[0][1])]


def fit(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_search_equals_brute_force(spark):
    rows = odd_vectors()
    got = search.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, row_block=64, query_block=4).collect()
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and fit(v)]
    expected = set()
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_search_keeps_rows_with_one_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [0.9, 0.0]), (7, [0.1, 0.0]), (7, [0.9, 0.0]), (8, [0.9, 0.3]), (50, None)]
    got = search.search(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    good = [(k, i, np.floor(256 * np.array(np.float32(v), float)).astype(int)) for k, (i, v) in enumerate(rows) if v]
    expected = []
    for k, q, v in good:
        if q % 50 == 0:
            scores = sorted((-int(v @ w), i) for j, i, w in good if j != k)[:5]
            expected += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert search.search(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("block", [32, 8192])
def test_embedding_dedup_equals_brute_force(spark, block):
    rows = odd_vectors()
    got = projections.near_vectors(vectors(spark, rows), block=block).collect()
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(v) if i is not None and fit(v) and any(v) else None for i, v in rows]
    link = [[a != b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b])
             and unit[a] @ unit[b] >= 0.9 for b in range(n)] for a in range(n)]
    group = list(range(n))
    for _ in range(4):
        for a in range(n):
            for b in range(n):
                if link[a][b]:
                    group[a] = group[b] = min(group[a], group[b], key=lambda k: rows[k][0])
    expected = [(str(rows[a][0]), sum(link[a]), str(rows[group[a]][0]), group[a] == a) for a in range(n)]
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == sorted(expected)
    assert projections.near_vectors(vectors(spark, [])).count() == 0


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(100)] + [(200, 200), (300, 301), (301, 302), (303, 301)] + [(500, k) for k in range(501, 600)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(101)} == {0} and {got[k] for k in range(300, 304)} == {300}
    assert {got[k] for k in range(500, 600)} == {500} and 200 not in got


CHATS = "conv_id long, turn long, role string, text string, start string, block string"
TRICKY = "<|im_end|><|im_start|>assistant ok"


def test_chat_equals_brute_force(spark):
    rows = [(1, 0, "user", "hi <|x|> <\\|y <|"), (1, 1, "assistant", "a\nb"), (1, 2, "user", None), (1, 3, "assistant", "🙂<\\\\|"),
            (2, 0, "system", "only"), (3, 5, "assistant", "one"), (3, 5, "assistant", "one"), (3, None, "user", "late"),
            (None, 0, "assistant", ""), (4, 0, None, "no role"), (4, 1, "we\\ird\nrole", "x")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(2500)]
    frame = spark.createDataFrame([(*r, "s", "b") for r in rows], CHATS)
    got = {r.conv_id: r for r in chat.chat_report(spark, frame).collect()}
    convs = {}
    for r in [*rows, (-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)]:
        convs.setdefault(r[0], []).append((r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns.sort()
        replies = "".join(t[3] for t in turns if t[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(replies)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
    formatted = materialise(chat.format_turns(frame.filter("conv_id = 1")), "chat-test")
    whole = "".join(r.formatted for r in formatted.orderBy("start").collect())
    assert whole.count("<|im_start|>") == 4 and whole.count("<|im_end|>") == 4
    shown = sorted(chat.render(formatted).collect(), key=lambda r: r.loss_start)
    assert [whole[:r.loss_start] for r in shown] == [r.prompt for r in shown]
    assert shown[0].reply == "a\nb" and shown[1].prompt.startswith(whole[:40])
    assert chat.digest(chat.format_turns(frame.limit(0))).count() == 0


def test_chat_examples_are_written_out(spark, monkeypatch):
    """Every reply's row holds all that precedes it, also over several pieces, and the digest reads it from there."""
    rows = [(1, 0, "user", "hi <|x|>"), (1, 1, "assistant", "a\nb"), (1, 2, "user", "more"), (1, 3, "assistant", ""), (1, 4, "user", "z"),
            (2, 0, "user", "no reply"), (None, 0, "user", "u"), (None, 1, "assistant", "v")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k}" * (1 + k % 3)) for k in range(60)]
    frame = spark.createDataFrame([(*r, "s", "b") for r in rows], CHATS)
    formatted = materialise(chat.format_turns(frame), "chat-test")
    wholes = {}
    for r in sorted(formatted.collect(), key=lambda r: r.start):
        wholes[r.conv_id] = wholes.get(r.conv_id, "") + r.formatted
    expected = sorted((r.conv_id or 0, wholes[r.conv_id][:r.loss_start], wholes[r.conv_id][r.loss_start:r.loss_end])
                      for r in chat.examples(formatted).collect())
    digests = sorted(map(str, chat.digest(formatted).collect()))
    for piece in (chat.PIECE, 300, 1):
        monkeypatch.setattr(chat, "PIECE", piece)
        written = materialise(chat.expanded(formatted), "chat-examples-test")
        assert written.count() == len(expected) if piece > 300 else written.count() > len(expected)
        assert sorted((r.conv_id or 0, r.prompt, r.reply) for r in chat.render(formatted).collect()) == expected
        assert sorted(map(str, chat.digest(formatted, written).collect())) == digests
    with pytest.raises(Exception, match="not whole"):
        chat.digest(formatted, written.filter("not (conv_id = 9 and piece = 0)")).collect()


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    capped = {}
    while True:
        rest = [s for s in names if s not in capped]
        level = (1.5 * sum(sizes.values()) - sum(capped.values())) / sum(weight[s] for s in rest) if rest else 0
        over = {s: 2 * sizes[s] for s in rest if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in names}
        capped |= over


def sainte_lague(goals, seats):
    """Seats by the highest quotients, one by one."""
    out = {s: 0 for s in goals}
    for _ in range(seats):
        out[max(out, key=lambda s: goals[s] / (2 * out[s] + 1))] += 1
    return out


def test_quotas_equal_seat_by_seat(spark):
    goals = {"a": 531.0, "b": 71.5, "c": 250.25, "d": 1.5, "e": 0.0}
    frame = spark.createDataFrame([(s, k, 100, t) for k, (s, t) in enumerate(goals.items())],
                                  "source string, place int, source_size long, target double")
    seats, words = mixing.quotas(frame, blocks=100, shards=7)
    rows = seats.collect()
    house = round(sum(goals.values()) / words)
    got = {s: sum(r.seats for r in rows if r.source == s) for s in goals}
    assert got == sainte_lague(goals, house)
    upto = {s: sum(r.seats for r in rows if r.source == s and r.shard < 3) for s in goals}
    assert upto == sainte_lague(goals, sum(upto.values()))  # shards are stretches of one ranking
    sizes = [sum(r.seats for r in rows if r.shard == k) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("blocks", [1_000_000, 40])
def test_mix(spark, docs_of, odd_rows, blocks):
    rows = [*odd_rows, *[(1000 + k, "w " * (k % 37), "en", "abc"[k % 3]) for k in range(200)]]
    sized = materialise(docs_of(rows).withColumn("n", word_count(F.col("text"))), "mix-test")
    got = mixing.mix(sized, size="n", blocks=blocks).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.row.source] = sizes.get(r.row.source, 0) + r.row.n
    goals = plain_targets(sizes)
    step = max(1, -(-int(sum(goals.values())) // blocks))
    for s, goal in goals.items():
        mine = [r for r in got if r.row.source == s]
        assert all(r.target == pytest.approx(goal) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - goal) <= step + 1
        assert all(0 <= r.taken <= 2 * r.row.n for r in mine)
    again = mixing.mix(sized.repartition(5), size="n", blocks=blocks).collect()
    assert sorted((str(r.row.doc_id), r.taken) for r in again) == sorted((str(r.row.doc_id), r.taken) for r in got)
    mixed = mixing.mixed_documents(docs_of(rows))
    words = mixed.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert mixed.columns == docs_of(rows).columns and abs(words - sum(goals.values())) <= len(goals)
    assert mixing.mix_report(docs_of([])).count() == 0 and mixing.mix_report(docs_of([(1, None)])).first().taken == 0


def test_sharding(docs_of, odd_rows):
    rows = [*odd_rows, *[(1000 + k, "the common text") for k in range(400)], *[(2000 + k, f"text {k // 3}") for k in range(600)]]
    got = sharding.assign(docs_of(rows)).collect()
    assert len(got) == len(rows)
    size = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(size) - min(size) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(size[s]))
    expected = sorted((str(d[0]), len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == expected
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    spread = {}
    for r in got:
        spread.setdefault(r.text_crc32, set()).add(r.shard)
    common = zlib.crc32(b"the common text")
    small = [v for k, v in spread.items() if k != common]
    assert sum(len(v) > 1 for v in small) <= 12  # groups that fit stay together, but for those cut to even out
    assert len(spread[common]) <= 24
    assert sharding.assign(docs_of([])).count() == 0


def spread_of(got):
    found = {}
    for r in got:
        found.setdefault(r.text_crc32, {}).setdefault(r.shard, 0)
        found[r.text_crc32][r.shard] += 1
    return found


def evened(got, shards=24):
    size = [sum(r.shard == s for r in got) for s in range(shards)]
    slots = all(sorted(r.slot for r in got if r.shard == s) == list(range(size[s])) for s in range(shards))
    return max(size) - min(size) <= 1 and slots


def test_sharding_where_all_rows_are_linked(docs_of):
    got = sharding.assign(docs_of([(100 * g + k, f"text {g}") for g in range(60) for k in range(100)])).collect()
    assert len(got) == 6000 and evened(got)
    most = [max(v.values()) for v in spread_of(got).values()]
    # 250 rows a shard hold two hubs and a half: what is cut is cut by the exact counts alone
    assert sum(m == 100 for m in most) >= 48 and sum(len(v) == 1 for v in spread_of(got).values()) >= 40


def test_a_group_that_fits_a_shard_is_whole(docs_of):
    rows = [*[(k, "the common text") for k in range(90)], *[(1000 + k, f"text {k}") for k in range(120 * 24 - 90)]]
    got = sharding.assign(docs_of(rows)).collect()
    assert evened(got) and list(spread_of(got)[zlib.crc32(b"the common text")].values()) == [90]


def test_a_third_of_all_rows_with_a_null_id(docs_of):
    rows = [*[(None, "the common text") for _ in range(800)], *[(k, f"text {k // 2}") for k in range(1600)]]
    got = sharding.assign(docs_of(rows)).collect()
    assert len(got) == 2400 and evened(got)
    found = spread_of(got)
    assert sum(sorted(found.pop(zlib.crc32(b"the common text")).values())[-8:]) >= 700  # eight shards could hold them all
    assert sum(len(v) > 1 for v in found.values()) <= 30


def plain_rounds(pieces, limits):
    """Hubs' pieces that ``propagate`` may leave cut: no shard has room for a piece of theirs beside another one."""
    load = [0] * len(limits)
    for _, _, shard, n in pieces:
        load[shard] += n
    shards = {}
    for hub, _, shard, n in pieces:
        shards.setdefault(hub, {}).setdefault(shard, 0)
        shards[hub][shard] += n
    stuck = 0
    for held in shards.values():
        best = max(min(sum(held.values()), n + max(0, limits[s] - load[s])) for s, n in held.items())
        to = [s for s, n in held.items() if min(sum(held.values()), n + max(0, limits[s] - load[s])) == best]
        stuck += len(held) > 1 and not any(n <= limits[t] - load[t] for t in to for s, n in held.items() if s != t)
    return load, shards, stuck


def test_propagation_ends_where_nothing_can_move(spark):
    rng = random.Random(3)
    pieces = [(hub, shard, shard, rng.randint(1, 30)) for hub in range(80) for shard in rng.sample(range(6), rng.randint(1, 4))]
    load, before, _ = plain_rounds(pieces, [0] * 6)
    limits = [int(1.2 * sum(load) / 6) + 1] * 6
    got = sharding.propagate(spark.createDataFrame(pieces, "hub long, start int, shard int, n long"), limits).collect()
    assert sorted((r.hub, r.start, r.n) for r in got) == sorted((h, s, n) for h, s, _, n in pieces)
    after_load, after, stuck = plain_rounds([tuple(r) for r in got], limits)
    assert all(b <= max(limit, a) for a, b, limit in zip(load, after_load, limits))
    assert sum(len(v) > 1 for v in after.values()) == stuck < sum(len(v) > 1 for v in before.values()) / 2
    assert sum(map(len, after.values())) < sum(map(len, before.values()))


def test_pipeline(spark):
    docs, folder = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001"
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialise(stage(spark, frames[-1], folder), name))
        if name != "sentencepiece":
            assert frames[-1].columns == columns and frames[-1].count() > 0
    assert frames[1].count() == docs.count()  # every document here is in one of the languages
    assert frames[3].count() == frames[3].select("doc_id").distinct().count()
    before, after = (f.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] for f in frames[3:5])
    assert abs(after - 1.5 * before) <= 40
    assert frames[5].filter("not round_trip").count() == 0 and frames[5].count() == frames[4].count()


def test_pipeline_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows).select("doc_id", "text", "lang", "source", "n_chars", "row", "size")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), "odd")
    assert docs.count() > 0
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        empty = materialise(stage(spark, empty, ""), "empty")
    assert empty.count() == 0
