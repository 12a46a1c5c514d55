import itertools
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyquilt.llm import linededup, quality, simhash, toxicity
from skyquilt.llm.components import components
from skyquilt.llm.queries import may_learn, op2_toxicity, op4_quality, op7_simhash, op8_line_dedup

from .conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality -------------------------------------------------------------------------------------------------


def measured(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def kept(text, n, chars, symbols, dup, repeat):
    text = text or ""
    count = lambda kind: len(re.findall(kind, text))
    lines = text.split("\n")
    base = n < 20 or 100 * repeat > 30 * n
    bad = not 2 * n <= chars <= 16 * n or symbols * 4 > n or dup * 10 > n or count("[A-Z]") * 2 > chars or count("[!?]") * 4 > n or count("[0-9]") * 2 > chars
    bad = bad or max(map(len, WORDS.findall(text)), default=0) >= 200 or 10 * len(set(WORDS.findall(text))) < n
    bad = bad or 10 * sum(bool(re.match(r"[\x20\x09-\x0D]*[-*\u2022]", x)) for x in lines) > 9 * len(lines)
    return base, not (base or bad)


def test_quality_whole_table(spark, sf, docs):
    want = sorted((r.doc_id, *(m := measured(r.text)), *kept(r.text, *m)) for r in docs.collect())
    assert sorted(map(tuple, op4_quality(spark, sf).collect())) == want
    assert 0.5 < np.mean([w[-1] for w in want]) < 1


def test_quality_odd_rows(spark, odd, clashing, empty):
    for table in (odd, clashing):
        got = quality.measured_and_judged(table).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *(m := measured(r[1])), *kept(r[1], *m))) for r in ODD)
        names = [r.rejected_by for r in quality.judge(table).orderBy("doc_id").collect()]
        assert all(n is None or n in quality.text_rules(F.col("text")) for n in names)
    assert quality.judge(empty).count() == 0 and quality.measured_and_judged(empty).count() == 0
    text = " ".join("word" + c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
    bad = {"shouting": text.upper(), "exclaiming": text + "!" * 9, "digits": " ".join(str(10**6 + k) for k in range(30)), "long_word": text + " " + "x" * 200, "bullets": "\n".join(f"- item number {k} of all" for k in range(10)), "few_distinct": " ".join(["a b c d e f g h i", "b a d c f e h g i", "c a b e f d h i g"] * 5)}
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([text, *bad.values()])], "doc_id long, text string")
    named = quality.judge(rows, rules=quality.further_rules(F.col("text"), quality.words(F.col("text")), quality.n_words(F.col("text")), quality.word_chars(F.col("text"))))
    assert [r.rejected_by for r in named.orderBy("doc_id").collect()] == [None, *bad]


def test_cascade_order_is_by_rejections_per_cost_and_changes_no_verdict(docs):
    rules = quality.text_rules(F.col("text"))
    ticks = iter([x for k in range(len(rules) + 1) for x in (100 * k, 100 * k + 1 + k)])  # the k-th rule takes k seconds more than none
    order = quality.rank_rules(quality.sampled(docs, 150), rules, repeats=1, clock=lambda: next(ticks))
    assert sorted(s for _, s, _ in order) == list(range(1, len(rules) + 1))
    assert [n for n, *_ in order] == [n for n, *_ in sorted(order, key=lambda x: -x[2] / x[1])]
    verdicts = [{r[0] for r in docs.where(quality.cascade(rules, list(names)).isNull()).select("doc_id").collect()} for names in (rules, list(rules)[::-1])]
    assert verdicts[0] == verdicts[1]


def test_rules_after_a_rejection_are_not_evaluated(spark):
    rows = spark.range(100).withColumn("text", F.when(F.col("id") < 60, F.lit("bad")).otherwise(F.lit("good")))
    explodes = F.when(F.col("text") == "bad", F.raise_error(F.lit("evaluated"))).otherwise(F.lit(False)).cast("boolean")
    rules = {"cheap": F.col("text") == "bad", "dear": explodes}
    assert rows.select(quality.cascade(rules, ["cheap", "dear"]).alias("x")).groupBy("x").count().orderBy("count").collect()[1]["count"] == 60
    with pytest.raises(Exception, match="evaluated"):
        rows.select(quality.cascade(rules, ["dear", "cheap"]).alias("x")).collect()


# ---- line dedup ----------------------------------------------------------------------------------------------


def lined(rows, ratio=0.05, least=3):
    trim = lambda x: x.strip(" \t\n\x0b\x0c\r")
    pages, seen = Counter(s for _, s, _ in rows), Counter()
    for _, s, t in rows:
        for x in {trim(x) for x in (t or "").split("\n")} - {""}:
            seen[s, x] += 1
    out = []
    for d, s, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = [x for x in lines if trim(x) and seen[s, trim(x)] >= least and seen[s, trim(x)] > ratio * pages[s]]
        stay = [x for x in lines if not (trim(x) and seen[s, trim(x)] >= least and seen[s, trim(x)] > ratio * pages[s])]
        out.append((d, sum(bool(trim(x)) for x in lines), len(gone), None if t is None else "\n".join(stay)))
    return sorted(out, key=repr)


def test_lines_whole_table(spark, docs, sf):
    want = lined([(r.doc_id, r.source, r.text) for r in docs.collect()])
    assert sorted(map(tuple, op8_line_dedup(spark, sf).collect()), key=repr) == want
    assert sum(w[2] for w in want) > 0


def test_lines_odd_rows(odd, clashing, empty):
    for table in (odd, clashing):
        out = linededup.drop_boilerplate(table, ratio=0.3, lines_col="__l", dropped_col="__d")
        assert [c for c in out.columns if c not in ("__l", "__d")] == table.columns
        assert sorted((tuple(r) for r in out.select("doc_id", "__l", "__d", "text").collect()), key=repr) == lined([(r[0], r[3], r[1]) for r in ODD], 0.3)
    assert linededup.drop_boilerplate(empty).count() == 0


# ---- SimHash -------------------------------------------------------------------------------------------------


def slow_fingerprint(text, width=4):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, ids, distance=4):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for p, d in zip(prints, ids):
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    return [least.get(find(p)) for p in prints]


def test_simhash_whole_table(spark, sf, docs):
    rows = docs.collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    want = sorted((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, slow_components(prints, [r.doc_id for r in rows])))
    assert sorted(map(tuple, op7_simhash(spark, sf).collect())) == want


def test_simhash_odd_rows(odd, clashing, empty):
    prints = [slow_fingerprint(r[1]) for r in ODD]
    want = sorted(((r[0], c) for r, c in zip(ODD, slow_components(prints, [r[0] for r in ODD]))), key=repr)
    for table in (odd, clashing):
        assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(table).collect()), key=repr) == want
        left = simhash.deduplicate(table)
        assert left.columns == table.columns
        assert sorted((r.doc_id for r in left.collect()), key=repr) == [1, 2, 5, 7, 8, None]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_links_of_hot_lists_connect_what_brute_force_connects(spark, block):
    generator = np.random.default_rng(5)
    base = [int(x) for x in generator.integers(0, 1 << 63, 6)]
    prints = {b ^ sum(1 << int(k) for k in generator.choice(64, generator.integers(0, 7), replace=False)) for b in base for _ in range(60)} | {0, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), block=block))
    found = {r.node % (1 << 64): r.root for r in roots.collect()}
    groups = {}
    for p in prints:
        groups.setdefault(found.get(p, p if p < 1 << 63 else p - (1 << 64)), set()).add(p)
    truth = {}
    for p, c in zip(prints, slow_components(list(prints), list(prints))):
        truth.setdefault(c, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_postings_contain_a_part_of_every_choice_of_matches():
    for distance in range(8):
        matches = 8 - distance
        for together in {matches, max(1, matches - 1)}:
            sets = [set(c) for c in simhash.postings(matches, together)]
            assert all(len(c) == together for c in sets)
            assert all(any(c <= set(choice) for c in sets) for choice in itertools.combinations(range(8), matches))
    assert len(simhash.postings(4, 3)) == 20 and len(simhash.postings(4, 4)) == 70
    assert [simhash.bytes_together(4, n) for n in (10, 10_000_000, 20_000_000)] == [3, 3, 4] and simhash.bytes_together(3, 1_000_000) == 3


def test_pairs_under_the_tally_are_dropped_before_bits_are_counted():
    a = np.uint64(0)
    close = np.uint64(0b1111)  # 4 bits of one byte: seven bytes shared
    spread = np.uint64(0x0101010101)  # 5 bits in 5 bytes: three shared
    assert simhash.similar(np.array([a ^ close, a ^ spread, a]), 4).tolist() == [True, False, True]
    assert simhash.similar(np.array([np.uint64(0xFF)]), 4).tolist() == [False]


@pytest.mark.parametrize("together", [3, 4])
def test_both_kinds_of_postings_find_the_same_links(spark, together):
    generator = np.random.default_rng(9)
    base = generator.integers(0, 1 << 63, 40)
    prints = sorted({int(b) ^ sum(1 << int(k) for k in generator.choice(63, generator.integers(0, 6), replace=False)) for b in base for _ in range(10)})
    roots = components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), together=together))
    found = {r.node: r.root for r in roots.collect()}
    assert [found.get(p, p) for p in prints] == slow_components(prints, prints)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_postings_are_never_broadcast(spark, tmp_path, adaptive):
    prints = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 4000).tolist()
    spark.createDataFrame([(p,) for p in prints], "fp long").write.parquet(str(tmp_path / "entries"))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        found = simhash.links(spark.read.parquet(str(tmp_path / "entries")), distance=5)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(-5, 200), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[k] == 100 for k in range(100, 140)) and found[200] == found[-5] == -5


def test_rows_of_one_id_go_by_their_own_fingerprint(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black brown")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (4, a)], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in simhash.deduplicate(docs).collect())
    assert kept == [(1, a), (2, b), (4, c)]


# ---- toxicity ------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    scored = op2_toxicity(spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.005
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_toxicity_odd_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 0), (7, 1), (8, 0), (8, 0), (None, 1), (99, 1), (5, None)], "doc_id long, toxic int")
    for table in (odd, clashing):
        model = toxicity.Toxicity().fit(table, labels)
        out = model.score(table, score_col="__s")
        assert out.columns == [*table.columns, "__s"]
        assert all(0 <= r["__s"] <= 1 for r in out.collect()) and out.count() == len(ODD)
    assert toxicity.Toxicity().fit(empty, labels).score(empty).count() == 0
    assert {r.score for r in toxicity.Toxicity().fit(odd, labels.where("toxic = 0")).score(odd).collect()} == {0.0}
    assert may_learn() is not None


def slow_words(text):
    punctuation = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
    return [(w.strip(punctuation.encode()) or w) for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").lower().encode()) if w]


def slow_shared(words):
    """P(last byte | bytes before it) of the corpus by interpolated Kneser-Ney, from sets of grams."""
    sets = {6: {(b"\0" * 5 + w + b"\1")[i : i + 6] for w in words for i in range(len(w) + 1)}}
    for k in range(5, 0, -1):
        sets[k] = {g[1:] for g in sets[k + 1]}
    count = {k: Counter(g[1:] for g in sets[k + 1]) for k in range(1, 6)}
    total, kinds = ({k: Counter() for k in range(1, 6)} for _ in range(2))
    for k in range(1, 6):
        for g, n in count[k].items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(g):
        out = 1 / 256
        for k in range(1, 6):
            t = g[len(g) - k :]
            out = (max(count[k][t] - 0.75, 0) + 0.75 * kinds[k][t[:-1]] * out) / total[k][t[:-1]]
        return out

    return p


def slow_ratio(counts, shared):
    """log P(word | toxic) - log P(word | ordinary) by the definition; counts: words' numbers of texts by class."""
    grams = [Counter(), Counter()]
    for y in (0, 1):
        for w, n in counts[y].items():
            for i in range(len(w) + 1):
                grams[y][(b"\0" * 11 + w + b"\1")[i : i + 12]] += n
    total, left = ([Counter(), Counter()] for _ in range(2))
    for y in (0, 1):
        for g, n in grams[y].items():
            total[y][g[:-1]] += n
            left[y][g[:-1]] += min(n, 2)

    def p(y, g):
        t = total[y][g[:-1]]
        return (max(grams[y][g] - 2, 0) + left[y][g[:-1]] * shared(g[-5:])) / t if t else shared(g[-5:])

    def ratio(word):
        return round(sum(np.log(p(1, g)) - np.log(p(0, g)) for g in ((b"\0" * 11 + word + b"\1")[i : i + 12] for i in range(len(word) + 1))), 9)

    return ratio


def slow_features(text, ratio):
    r = [ratio(w) for w in slow_words(text)]
    if not r:
        return [0.0, 0.0, 0.0]
    strong = sorted({x for x in r if x > 1})[-3:]
    return [np.mean(r), np.mean([max(x - 2, 0) for x in r]), sum(strong) / 3]


def test_every_score_is_that_of_the_definition(spark, sf, docs):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(5)).alias("fold")).collect()
    shared = slow_shared({w for r in rows for w in slow_words(r.text)})
    learnt = [r for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    sample = {(r.text, labels[r.doc_id]): r.fold for r in learnt}

    def model(fold):
        counts = [Counter(), Counter()]
        for (t, y), f in sample.items():
            if f != fold:
                counts[y].update(set(slow_words(t)))
        return cache(slow_ratio(counts, shared))

    folds = {f: model(f) for f in range(5)}
    x = np.array([slow_features(t, folds[f]) for (t, _), f in sample.items()])
    y = np.array([c for _, c in sample], float)
    base = np.mean([labels[r.doc_id] for r in learnt])
    scale = x.std(0)
    beta = toxicity.logistic(x / scale, y, np.where(y == 1, base / y.sum(), (1 - base) / (1 - y).sum()) * len(y))
    whole = model(None)
    want = {r.doc_id: 1 / (1 + np.exp(-(np.array(slow_features(r.text, whole)) / scale @ beta[:-1] + beta[-1]))) for r in rows}
    got = {r.doc_id: r.score for r in op2_toxicity(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[d] - want[d]) for d in want) < 1e-7


def test_shared_counts_are_exact_for_a_large_vocabulary(spark):
    rng = np.random.default_rng(5)
    words = [bytes(w) for w in rng.integers(97, 123, (60_000, 8), np.uint8)]
    docs = spark.createDataFrame([(" ".join(w.decode() for w in words[k::50]),) for k in range(50)], "text string")
    back = {r.tail: r.back for r in toxicity.shared_backoff(docs, "text").collect()}
    assert len(back) > 250_000
    p = slow_shared(set(words))
    for w in words[:200]:
        for i in range(9):
            g = (b"\0" * 4 + w + b"\1")[i : i + 5]
            assert back[int.from_bytes(g, "big")] == pytest.approx(p(g), rel=1e-12)


def test_a_text_over_the_byte_bound_leaves_the_sample_whole(spark):
    texts = [(k, f"you are a wretched blackguard number {k} indeed" if k % 2 else f"a quiet walk by the river on day {k}") for k in range(200)]
    first = spark.range(1001, 100_000, 2).orderBy(F.xxhash64("id")).first()[0]  # in hash order this one is before all others
    texts.append((first, "wretched blackguard " * 1200))  # longer than the bound
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in texts] + [(10**6 + k, k % 2) for k in range(3000)], "doc_id long, toxic int")  # most have no document
    model = toxicity.Toxicity(class_bytes=20_000, per_class=150).fit(docs, labels)
    assert model.beta is not None
    rows = model.score(docs).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in rows)


def test_rows_of_a_repeated_id_give_one_text(spark):
    texts = [(k, f"you are a wretched blackguard number {k} indeed" if k % 2 else f"a quiet walk by the river on day {k}") for k in range(100)]
    docs = spark.createDataFrame(texts + [(1, f"a quiet walk number {k}") for k in range(500)], "doc_id long, text string")
    model = toxicity.Toxicity().fit(docs, spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int"))
    got = {r.text: r.score for r in model.score(docs).where("doc_id between 2 and 99").collect()}
    assert all((s >= 0.5) == ("wretched" in t) for t, s in got.items())
