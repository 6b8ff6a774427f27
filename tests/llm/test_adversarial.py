"""Inputs on which hashes clash, numbers are large, and batches come one by one; rates and posteriors by brute force."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from test_corpus_operators import WORDS, corpus, jaccard_components, repeats, seen_windows

from tidewright.llm import mixing, ngram_join, quality, substring_index, suffix_array, suffix_dedup, topk_search

TOP = 2**63 - 1


def thue_morse(n: int, a: str, b: str) -> str:
    """A word whose polynomial hashes modulo 2^64 equal those of its complement, whatever the odd root."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_clashing_bytes(spark):
    middle = bytes.fromhex("2463265042457e5b7b2764603f6d61493c6d486b6273536f304062543443636b4838592f2e5c5d2638456331267142617b6f4064673d6b7930212d6e78526e30").decode()
    one, two = (thue_morse(128, *x) for x in (("Pc", "e4"), ("e4", "Pc")))
    rows = [(1, one[:128] + middle + one[128:]), (2, two[:128] + middle + two[128:]), (TOP, "x")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 0), (TOP, 0)]


def test_clashing_words(spark):
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    common = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{common} {x}"), (2, f"{common} {y}"), (TOP, f"{common} {x}")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_index.remove_seen_windows(docs).collect()}
    assert got == {1: (50, 0), 2: (50, 0), TOP: (50, 50)}
    docs = spark.createDataFrame([(1, x), (2, y), (3, x.upper()), (TOP, "z")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, words=3, percent=90).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), TOP: (1, TOP)}


def test_clashing_grams_count_apart():
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    text = f"{x} q r {y} q r".encode()
    sets = ngram_join.GramSets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 3)
    assert sets.sizes.tolist() == [len({tuple(text.split()[i : i + 3]) for i in range(4)})] == [4]


def test_index_in_separate_calls(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    want, got = seen_windows(rows, 50), {}
    for lo, hi in ((0, 9), (9, 12), (12, 13), (13, 20), (20, 99)):
        path = f"{tmp_path}/index"
        index = substring_index.FingerprintIndex(spark, path) if not lo else substring_index.FingerprintIndex.open(spark, path)
        part = index.add(docs.filter(f"doc_id >= {lo} and doc_id < {hi}"), with_kept=False)
        got |= {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in part.collect()}
        index.close()
    assert got == want
    assert [len(level) for level in index.levels] == [2, 1]
    index.drop()
    assert spark.sql("SHOW TABLES").filter("tableName LIKE 'tidewright_%'").isEmpty()


def test_batches_on_top_of_an_index(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    index = substring_index.FingerprintIndex(spark, f"{tmp_path}/index")
    parts = [index.add(docs.filter("doc_id <= 9"), with_kept=False), index.add_each(docs.filter("doc_id > 9"), [10, 12, 13, 19], with_kept=False)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for part in parts for r in part.collect()}
    assert got == seen_windows(rows, 50)
    assert [len(level) for level in index.levels] == [0, 2]
    index.drop()


def test_batches_of_a_table_are_verified_together(spark):
    """Each further batch costs its run, its look-up and its share of compaction, not another pass over the texts."""
    docs = spark.createDataFrame([r[:2] for r in corpus()], "doc_id long, text string")
    jobs = {}
    for batches in (1, 5):
        spark.sparkContext.setJobGroup(f"op8-{batches}", "")
        substring_index.remove_seen_windows(docs, batches=batches).collect()
        jobs[batches] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"op8-{batches}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[5] - jobs[1] <= 8 * 4, jobs


def test_slices_and_segments(spark):
    """Texts and copies longer than a slice, a segment and an array."""
    r = random.Random(8)
    long = " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(40_000))
    rows = [(1, long), (2, "new " + long), (3, long[:150_000] + " cut " + long[200_000:]), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suffix_dedup.remove_repeats(docs).collect()}
    want = {i: (removed, spans, kept) for (i, _), (kept, removed, spans) in zip(rows, repeats([t.encode() for _, t in rows], 200), strict=True)}
    assert got == want
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_index.remove_seen_windows(docs, batches=2).collect()}
    assert got == seen_windows(rows, 50)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_duplicates(docs, words=3, percent=90).collect()}
    assert got == jaccard_components(rows, 3, 90)


def test_null_and_repeated_ids(spark):
    texts = [" ".join(random.Random(i).choice(WORDS) for _ in range(60)) for i in range(3)]
    rows = [(None, texts[0]), (None, texts[0]), (5, texts[1]), (5, texts[0]), (7, texts[1]), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_index.remove_seen_windows(docs).collect())
    assert got == [("5", 60, 0), ("5", 60, 0), ("7", 60, 60), ("8", 0, 0), ("None", 60, 60), ("None", 60, 60)]
    got = sorted((str(r["doc_id"]), r["n_shingles"] > 0, r["component_id"]) for r in ngram_join.near_duplicates(docs).collect())
    assert got == [("5", True, 5), ("5", True, 5), ("7", True, 5), ("8", False, 8), ("None", True, 5), ("None", True, 5)]


def test_pairs_sorted_to_any_depth():
    rng = np.random.default_rng(5)
    base = rng.integers(97, 100, 300).astype(np.uint8)
    text = np.concatenate([base, [255], base, [255], base[:200], [255]]).astype(np.uint8)
    order = suffix_array.sort_suffixes(text, np.ones(len(text), bool), 120)
    raw = text.tobytes()
    heads = [raw[i : i + 120] for i in order]
    assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(text)))


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(1100, [3.0e6, 1.0]), (1200, [1e20] * 3), (1201, [-1e20, 5.0]), (1300, [1.6e308, -3.0]), (1301, [float("inf")]), (1302, [2.0**52 + 0.5, -0.0003])]
    got = sorted(map(tuple, topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] + [0] * (6 - len(v)) for i, v in rows if all(map(math.isfinite, v))}
    want = []
    for q in whole:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:10]
            want += [(q, k, i, max(-TOP - 1, min(TOP, -s))) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    scores = [0, 1, -1, 255, -256, TOP, -TOP - 1, 10**40, -(10**40), 10**300]
    assert sorted(scores) == sorted(scores, key=topk_search.order_key)


def test_blocks(spark, monkeypatch):
    """Several candidate and query blocks, whose answers meet in the end."""
    monkeypatch.setattr(topk_search, "ROWS_PER_BLOCK", 64)
    monkeypatch.setattr(topk_search, "QUERIES_PER_BLOCK", 2)
    rng = np.random.default_rng(9)
    vectors = np.floor(1024 * rng.normal(size=(600, 5))).astype(np.int64)
    df = spark.createDataFrame([(i, (v / 1024).tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = []
    for q in range(0, 600, 100):
        best = sorted((-int(vectors[q] @ v), i) for i, v in enumerate(vectors) if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, topk_search.top_k(df).collect())) == sorted(want)


def test_rates_by_brute_force(spark):
    """Each source's rates against bisection on the dual, and its copies against the rounding rule."""
    r = random.Random(3)
    docs = [(i, " ".join(["w"] * r.randrange(1, 40)), f"s{i % 5}") for i in range(300)]
    rows = mixing.mix_to_targets(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for s in {x["source"] for x in rows}:
        mine = [x for x in rows if x["source"] == s]
        sizes, target = sorted({x["size"] for x in mine}, reverse=True), mine[0]["target"]
        n = {z: sum(x["size"] == z for x in mine) for z in sizes}
        mean = sum(x["size"] for x in mine) / len(mine)
        rate = lambda z, lam: min(3.0, math.exp(min(700, lam * z / mean)))  # noqa: B023, E731
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n[z] * z * rate(z, mid) for z in sizes) < target else (lo, mid)
        carry = 0.0
        for z in sizes:
            want = n[z] * z * rate(z, lo) + carry
            k = min(max(round(want / z), 0), 3 * n[z])
            carry = want - k * z
            assert abs(sum(x["copies"] for x in mine if x["size"] == z) - k) <= 1
        assert abs(sum(x["taken"] for x in mine) - target) <= max(sizes) / 2 + 1


def test_posteriors_by_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        bad = r.random() < (0.7 if i % 4 == 0 else 0.2)
        rows.append((i, " ".join(r.choice(WORDS) + ("%%" if bad and r.random() < 0.8 else "") for _ in range(30)), f"h{i % 4}", "en" if i % 8 < 4 else None, int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, q int")
    labels = df.filter("doc_id < 150").selectExpr("doc_id", "q as quality")
    got = {x["doc_id"]: x for x in quality.classify(df, labels).collect()}
    good = sum(x[4] for x in rows[:150]) / 150
    prior = math.log(good / (1 - good))
    share = {x[0]: float(x[4]) if x[0] < 150 else 1 / (1 + math.exp(-(got[x[0]]["evidence"] + prior))) for x in rows}
    total = (sum(share.values()) + 0.5) / (len(rows) + 1)

    def strength(sites, parents):
        n, p = {k: len(v) for k, v in sites.items()}, parents
        mean = {k: sum(v) / len(v) for k, v in sites.items()}
        within = sum(sum((x - mean[k]) ** 2 for x in v) for k, v in sites.items()) / max(1, sum(m - 1 for m in n.values()))
        between = (sum(n[k] * (mean[k] - p[k]) ** 2 for k in n) - len(n) * within) / sum(n[k] * p[k] * (1 - p[k]) for k in n)
        return max(1.0, 1 / max(between, 1e-4) - 1)

    hosts, paths = {}, {}
    for x in rows:
        hosts.setdefault(x[2], []).append(share[x[0]])
        paths.setdefault((x[2], x[3]), []).append(share[x[0]])
    host_k = strength(hosts, dict.fromkeys(hosts, total))
    parent = {h: (sum(v) + host_k * total) / (len(v) + host_k) for h, v in hosts.items()}
    path_k = strength(paths, {k: parent[k[0]] for k in paths})
    for x in rows:
        h, p, own = hosts[x[2]], paths[x[2], x[3]], share[x[0]]
        host_rate = (sum(h) - own + host_k * total) / (len(h) - 1 + host_k)
        path_rate = (sum(p) - own + path_k * host_rate) / (len(p) - 1 + path_k)
        assert got[x[0]]["host_rate"] == pytest.approx(host_rate, rel=1e-6)
        assert got[x[0]]["path_rate"] == pytest.approx(path_rate, rel=1e-6)
        assert got[x[0]]["score"] == pytest.approx(1 / (1 + math.exp(-got[x[0]]["evidence"]) * (1 - path_rate) / path_rate), rel=1e-6)
