"""The similarity join from 0.8 on: no pair lost, and few bytes moved for an item."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import dedup, segments


def edited(r, base, share):
    """base with about share of its items replaced."""
    return {x if r.random() > share else r.getrandbits(62) for x in base}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def some_sets(r):
    sets = []
    for n in [1, 2, 3, 5, 7, 12, 13, 20, 40, 66, 90, 200, 400]:
        base = {r.getrandbits(62) for _ in range(n)}
        sets += [base, set(base), *(edited(r, base, s) for s in (0.01, 0.04, 0.07, 0.08, 0.09, 0.12))]
        sets += [base | {r.getrandbits(62) for _ in range(k)} for k in (1, n // 8, int(n / 0.85) - n, n // 5)]
    return [*sets, set(range(50)), set(range(8, 50)), set(range(7, 50)), set()]


def test_pairs_at_high_thresholds_equal_brute_force(spark):
    sets = dict(enumerate(some_sets(random.Random(5))))
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id int, items array<bigint>")
    for t in (0.8, 0.85, 1.0):
        want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b] and jaccard(sets[a], sets[b]) >= t}
        got = [((x.a, x.b), x.common) for x in dedup.similar_pairs(df, t).collect()]
        assert len(got) == len(want) and dict(got) == want
    names = df.select(F.concat(F.lit("r"), "id").alias("id"), F.transform("items", lambda x: x.cast("string")).alias("items"))
    want = {tuple(sorted((f"r{a}", f"r{b}"))) for a in sets for b in sets if a < b and sets[a] & sets[b] and jaccard(sets[a], sets[b]) >= 0.85}
    assert {(x.a, x.b) for x in dedup.similar_pairs(names, 0.85).collect()} == want
    assert dedup.similar_pairs(df.limit(0), 0.85).count() == 0


def test_sketches_hold_every_pair_and_are_small():
    r, known = random.Random(6), 0
    for _ in range(3000):
        n = int(2 ** (r.random() * 10))
        x = {r.getrandbits(62) for _ in range(n)}
        y = edited(r, x, 0.08 * r.random()) | {r.getrandbits(62) for _ in range(int(n * 0.1 * r.random()))}
        if jaccard(x, y) >= 0.85:
            known += 1
            u, v = (segments.mixed(np.array(sorted(s), np.uint64)) for s in (x, y))
            (p, p_bits), (q, q_bits) = segments.sketch(np.sort(u), 0.85), segments.sketch(np.sort(v), 0.85)
            checks = dict(segments.names_of(p).T.tolist())
            assert any(name in checks and (checks[name] ^ check).bit_count() < segments.CHAIN for name, check in segments.names_of(q).T.tolist())
            assert segments.differ(p_bits, q_bits) <= len(x ^ y)
    assert known > 500
    sizes = [sum(map(len, segments.sketch(np.sort(segments.mixed(np.arange(n, dtype=np.uint64))), 0.85))) / n for n in range(100, 3000, 7)]
    assert sum(sizes) / len(sizes) < 3  # a stored item alone has 8 bytes


def test_words_are_cut_as_by_the_jvm(spark):
    texts = ["", "a", "a b c d", "a b c d e", "let x9 = $y_1+12; x9", "naïve été٣ = «x» + y z\x1c\u0085w", "𝒳a b𝒳c 名前１ $é", "a.b(c) => {d}[e] a.b(c) => {d}", "x\x00y\x0bz ^`|~\x7f", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sizes = {x.id: len(x.x) // 8 for x in segments.sets_of(segments.text_rows(df, id_col="id")).collect()}
    assert sizes == {x.id: x.n for x in df.select("id", F.size(T.shingles(F.col("text"))).alias("n")).collect()}
    pairs = dedup.rare_item_pairs(df.select("id", T.shingles(F.col("text")).alias("items")), 0.0).collect()
    rows = segments.text_rows(df, id_col="id")
    x = {r.id: set(np.frombuffer(r.x, np.uint64)) for r in segments.sets_of(rows).collect()}
    assert {(p.a, p.b, p.common) for p in pairs} == {(a, b, len(x[a] & x[b])) for a in x for b in x if a < b and x[a] & x[b]}


def test_leader_clusters_at_the_default_threshold_equal_a_sequential_scan(spark):
    r = random.Random(8)
    rows, plain = [], []
    for base in range(6):
        words = [f"w{r.randrange(50)}" for _ in range(60)]
        for k in range(14):
            own = list(words)
            if k % 3:
                at = r.randrange(60)
                own[at : at + k % 3] = [f"x{base}_{k}"] * r.randint(0, 2)
            rid, included, text = f"{r.random():.12f}", r.random() < 0.8, " ".join(own)
            rows.append((rid, text, included, text))
            plain.append((rid, text, included, {tuple(own[i : i + 5]) for i in range(len(own) - 4)}))
    leaders, want = [], {}
    for rid, norm, included, items in sorted(plain):
        leader = next((x for x in leaders if x[1] == norm), None) or next((x for x in leaders if included and x[2] and jaccard(items, x[3]) >= 0.85), None)
        if leader is None:
            leader = (rid, norm, included, items)
            leaders.append(leader)
        want[rid] = leader[0]
    assert 6 < len(set(want.values())) < 60
    df = spark.createDataFrame(rows, "record_id string, normalized_sha256 string, included boolean, text string").repartition(3)
    stored = []
    cut = segments.sets_of
    try:
        segments.sets_of = lambda rows: stored.append(rows) or cut(rows)
        assert {x.record_id: x.dedup_cluster for x in dedup.leader_clusters(df).collect()} == want
    finally:
        segments.sets_of = cut
    assert stored  # only what sketches leave gets its shingles
    texts = df.select("record_id", "text").unionByName(df.select("record_id", "text"))
    assert {x.record_id: x.dedup_cluster for x in dedup.leader_clusters(df.drop("text"), texts=texts).collect()} == want
