from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyquilt.llm import ann, mixing, sharding
from skyquilt.llm.queries import op6_mixing, op9_sharding, op10_ann

from .conftest import ODD


# ---- mixing --------------------------------------------------------------------------------------------------


def one_by_one(votes, seats, limits):
    won = [0] * len(votes)
    while seats > 0:
        open_ = [i for i in range(len(votes)) if votes[i] > 0 and won[i] < limits[i]]
        if not open_:
            break
        won[max(open_, key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        seats -= 1
    return won


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.5, 1.0, 3.0, 7.5, 1000.0]), st.integers(0, 40)), min_size=1, max_size=7), st.integers(0, 60))
def test_apportionment_is_sainte_lague(parties, seats):
    votes, limits = [v for v, _ in parties], [m for _, m in parties]
    assert mixing.apportion(votes, seats, limits) == one_by_one(votes, seats, limits)


def reshared(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        above = [s for s in rest if share[s] > 2 * sizes[s]]
        if not above:
            return full | share
        for s in above:
            full[s] = 2 * sizes[s]
            left -= full[s]


def check_mix(rows, table, slack):
    size = Counter()
    for d, s, t in table:
        size[s] += len((t or "").encode().split())
    goal = reshared(size)
    want = sorted(((d, len((t or "").encode().split()), size[s]) for d, s, t in table), key=repr)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in rows), key=repr) == want
    source = {d: s for d, s, _ in table}
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(goal[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    for s in size:
        assert abs(taken[s] - goal[s]) <= slack


def test_mix_whole_table_and_reruns(spark, sf, docs):
    rows = op6_mixing(spark, sf).collect()
    check_mix(rows, [(r.doc_id, r.source, r.text) for r in docs.collect()], slack=128)
    assert sorted(rows) == sorted(op6_mixing(spark, sf).collect())


def test_mix_many_shards(docs):
    check_mix(mixing.mix(docs, shard_words=20_000, block_words=8).collect(), [(r.doc_id, r.source, r.text) for r in docs.collect()], slack=80)


def test_small_sources_of_many_shards_come_near_their_targets(spark):
    """A source with few words a shard, one of a few words in all, and one of 100 words."""
    rows = [(k, " ".join(["w"] * 200), "big") for k in range(10_000)] + [(20_000 + k, "rare", "rare") for k in range(300)]
    rows += [(30_000, "one two three", "tiny"), *((40_000 + k, "five words are in here", "small") for k in range(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shard_words=2_000).groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    by = {r.source_size: (r.target, r.taken) for r in got}
    assert abs(by[2_000_000][0] - by[2_000_000][1]) <= 128
    for size, near in ((300, 8), (3, 1), (100, 2)):
        assert by[size][0] == pytest.approx(2 * size) and abs(by[size][1] - by[size][0]) <= near


def test_many_rows_without_an_id_are_spread_and_paired(spark):
    rows = [(None, f"text number {k} without an id", "a") for k in range(300)] + [(None, "the same text", "b")] * 100 + [(1, f"and one {k}", "b") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, shard_words=100, block_words=4)
    got = Counter()
    for r in mixing.repeat_taken(docs, mixed).collect():
        got[r.source] += len(r.text.split())
    want = {r.source: r.n for r in mixed.join(docs.select("source", F.xxhash64("text").alias("text_hash")).distinct(), "text_hash").groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert got == want and all(n > 0 for n in want.values())
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, mixing.mix(docs.repartition(7), shard_words=100, block_words=4).collect()))


def test_mix_odd_rows(odd, clashing, empty):
    table = [(r[0], r[3], r[1]) for r in ODD]
    for t in (odd, clashing):
        check_mix(mixing.mix(t).collect(), table, slack=128)
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mix(odd)
    out = mixing.repeat_taken(odd, mixed)
    assert out.columns == odd.columns
    words = sum(len((r.text or "").encode().split()) for r in out.collect())
    assert words == sum(r.taken for r in mixed.collect())


def test_mix_without_words(spark):
    rows = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in rows) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_repeated_texts_are_the_selected_blocks(spark):
    text = {"a": " ".join(f"a{k}" for k in range(6400)), "b": " ".join(f"b{k}" for k in range(6400))}
    docs = spark.createDataFrame([(1, text["a"], "a"), (2, text["b"], "b")], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, share=0.7)  # a: 6,400 words of 6,400; b: 2,560
    row = {r.doc_id: r for r in mixed.collect()}
    assert row[1].taken == 6400 and row[2].taken == 2560
    out = [r.text for r in mixing.repeat_taken(docs, mixed).collect()]
    assert [t for t in out if t.startswith("a")] == [text["a"]]
    assert [t for t in out if t.startswith("b")] == ["\n".join(" ".join(text["b"].split()[s.first : s.last]) for s in row[2].spans)]
    blocks = sorted(int(w[1:]) // 64 for t in out if t.startswith("b") for w in t.split()[::64])
    assert len(blocks) == 40 and max(np.diff(blocks)) <= 3 and blocks[-1] >= 97  # at even distances up to the end
    assert sorted(int(w[1:]) for t in out if t.startswith("b") for w in t.split()) == [64 * k + i for k in blocks for i in range(64)]


# ---- sharding ------------------------------------------------------------------------------------------------


def check_shards(rows, table, shards=8):
    import zlib

    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in table), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_whole_table(spark, sf, docs):
    rows = op9_sharding(spark, sf).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_shards_are_those_of_rows_placed_one_by_one(spark, docs):
    """The law by its definition: rows by place, first into their own shard while it has room, then the rest clockwise."""
    rows = sharding.shard(docs, shards=3, nodes=5)
    place = F.xxhash64(F.col("doc_id").cast("string"), "size", "text_crc32")
    table = [(r.place, r.doc_id, r.shard) for r in rows.select(place.alias("place"), "doc_id", "shard").collect()]
    points = sharding.ring(3, 5)
    arc = {d: next((i for i, (p, _) in enumerate(points) if p >= place), 0) for place, d, _ in table}
    order = sorted(table, key=lambda r: (arc[r[1]], r[0]))
    room, want, rest = [len(table) // 3 + (s < len(table) % 3) for s in range(3)], {}, []
    for _, d, _ in order:
        own = points[arc[d]][1]
        if room[own]:
            room[own] -= 1
            want[d] = own
        else:
            rest.append(d)
    for d in rest:
        step = arc[d]
        while not room[points[step % 15][1]]:
            step += 1
        room[points[step % 15][1]] -= 1
        want[d] = points[step % 15][1]
    assert want == {d: s for _, d, s in table}


def test_rows_without_an_id_lie_on_many_arcs(spark):
    table = spark.createDataFrame([(None, f"text {k}") for k in range(2000)], "doc_id long, text string")
    found = sharding.shard(table).groupBy("shard").agg(F.countDistinct("text_crc32").alias("n")).collect()
    assert sorted(r.n for r in found) == [250] * 8


def test_shards_odd_rows(odd, clashing, empty):
    for t in (odd, clashing):
        check_shards(sharding.shard(t).collect(), [(r[0], r[1]) for r in ODD])
    assert sharding.shard(empty).count() == 0


def test_overflow_goes_clockwise_and_growth_moves_little():
    generator = np.random.default_rng(2)
    n = 20_000
    places = np.sort(generator.integers(-(1 << 63), (1 << 63) - 1, n))
    owners = []
    for shards in (8, 9):
        points = sharding.ring(shards, 256)
        arcs = np.searchsorted([p for p, _ in points], places, "left") % len(points)
        counts = Counter(arcs.tolist())
        runs = sharding.plan(points, counts, shards)
        order = np.argsort(arcs, kind="stable")
        owner, starts = np.empty(n, int), {}
        for i, k in enumerate(order):
            starts.setdefault(arcs[k], i)
        covered = 0
        for arc, a, b, shard, _ in runs:
            owner[order[starts[arc] + a : starts[arc] + b]] = shard
            covered += b - a
        assert covered == n
        room = [n // shards + (s < n % shards) for s in range(shards)]
        assert Counter(owner.tolist()) == dict(enumerate(room))
        # a row away from its own shard: every shard on the way from its arc to where it went is full
        for arc, a, b, shard, _ in runs:
            if a == 0 or shard == points[arc][1]:
                continue
            assert Counter(owner.tolist())[points[arc][1]] == room[points[arc][1]]
        owners.append(owner)
    assert (owners[0] != owners[1]).mean() < 0.3  # 1/9 is what must move


# ---- nearest neighbours --------------------------------------------------------------------------------------


def exact(ids, vectors, queries, k=5):
    x = vectors.astype(float)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for q in queries:
        s = unit @ unit[ids.index(q)]
        order = sorted((-round(s[j], 12), ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
        out[q] = [i for _, i in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_and_scores(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = exact(ids, x, [i for i in ids if i % 50 == 0])
    found = defaultdict(dict)
    for r in op10_ann(spark, f"/root/testdata/{sf}").collect():
        found[r.query_id][r["rank"]] = r
        a, b = x[ids.index(r.query_id)], x[ids.index(r.vec_id)]
        assert r.score == pytest.approx(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), abs=1e-14)
    assert found.keys() == want.keys() and all(sorted(v) == [1, 2, 3, 4, 5] for v in found.values())
    for v in found.values():
        assert [(-v[k].score, v[k].vec_id) for k in range(1, 6)] == sorted((-v[k].score, v[k].vec_id) for k in range(1, 6))
    recall = np.mean([len({r.vec_id for r in found[q].values()} & set(want[q])) / 5 for q in want])
    assert recall >= 0.9


def test_odd_vectors_ties_and_hot_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, []), (None, [1.0, 1.0]), (50, [0.0, 2.0]), (100, [1e-200, 1e-200]), (100, [1e-200, 1e-200])]
    rows += [(1000 + 2 * k + 1, [3.0, 0.0]) for k in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("list", F.lit(2))
    got = defaultdict(list)
    for r in ann.search(table, F.col("vec_id") % 50 == 0, block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 12)))
    assert got[0] == [(1001 + 2 * k, 1.0) for k in range(5)]
    assert got[50][0] == (100, round(2**-0.5, 12)) and len(got[50]) == 5
    assert len(got[100]) == 5 and got.keys() == {0, 50, 100}
    assert ann.search(table.where("vec_id = 2"), F.col("vec_id") % 2 == 0).count() == 0
    few = ann.search(table.where("vec_id in (0, 50)"), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 50, 0.0)]


def test_exact_search_and_many_lists(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = rows.collect()
    ids, x = [r.vec_id for r in found], np.array([r.embedding for r in found], float)
    want = exact(ids, x, [i for i in ids if i % 50 == 0])
    for options in ({"exact": True, "block": 100}, {"exact": True}):
        got = defaultdict(list)
        for r in ann.search(rows, F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert got == want
    sample = np.random.default_rng(3).standard_normal((9000, 8))
    centroids = ann.fit_lists(ann._unit(sample), 2200)
    assert 2000 <= len(centroids) <= 2400 and np.isfinite(centroids).all()


def test_graph_search_finds_what_all_distances_find():
    generator = np.random.default_rng(0)
    centroids = generator.standard_normal((600, 16))
    graph = ann.CentroidGraph(centroids)
    assert not graph.small
    x = generator.standard_normal((200, 16))
    ids, d = graph.search(x, 16)
    truth = np.argsort(ann.squared(x, centroids), axis=1)[:, :16]
    assert np.mean([len(set(a) & set(b)) / 16 for a, b in zip(ids.tolist(), truth.tolist())]) > 0.9
    assert all(len(set(r)) == 16 for r in ids.tolist()) and (np.diff(d) >= 0).all()
