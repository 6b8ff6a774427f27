"""Operators against brute force on a small corpus with nulls, ties, copies, long texts and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat_format, exact_dedup, golomb, mixing, ngram_join, packing, quality, queries, substring_index, suffix_array, suffix_dedup, topk_search, url_filter
from tidewright.llm.components import connected_components

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ß") for b in ("ra", "se", "ti", "vo", "xy", "é")]
SCHEMA = "doc_id long, text string, source string, lang string, key long, id string, n int, sig string, kind string"


def corpus() -> list[tuple]:
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passage, base, long = say(70), say(120), say(6000)
    texts = [None, "", " \n ", "one", "One two", say(30), passage + " " + say(20), say(25) + " " + passage, base, base, base, base.replace("ra", "RA", 1), long, long[:9000] + " " + say(300), "x" * 900, "y" + "x" * 700, say(49), say(50), passage]
    for _ in range(12):
        w = base.split()
        w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    rows = [(i, t, None if i % 9 == 0 else f"s{i % 3}", "en", 7, "id", 1, "sig", "kind") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids."""
    rows = corpus()
    return spark.createDataFrame(rows + [(None, *rows[8][1:]), (None, *rows[5][1:]), rows[10], rows[10], (10, "other text", *rows[10][2:])], SCHEMA).repartition(3)


def texts() -> dict[int, str]:
    return {r[0]: r[1] or "" for r in corpus()}


def test_exact_dedup(docs, empty, odd):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    same = {}
    for i, t in texts().items():
        same.setdefault(t, []).append(i)
    for i, t in texts().items():
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(same[t]), len(same[t]), i == max(same[t]), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).collect() == []
    collided = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs, fingerprint=lambda t: F.length(t) % 2).collect()}
    assert collided == {i: r["keep_id"] for i, r in got.items()}
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == odd.count()
    assert len({r["text_sha256"] for r in rows}) == sum(r["kept"] for r in rows)
    kept = exact_dedup.keep_one_of_each(odd).collect()
    assert len(kept) == len({r["text_sha256"] for r in rows})
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one_of_each(docs).collect()) == sorted(max(v) for v in same.values())


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 300):
        v = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        for m in (golomb.parameter(len(v), 2**64), 2**50 + 1):
            if len(v) == 0 or int(v[-1]) // m < 10**6:
                assert (golomb.decode(golomb.encode(v, 0, m), len(v), 0, m) == v).all()
    small = np.unique(rng.integers(0, 900, 200, dtype=np.uint64))
    for m in (1, 2, 3, 7, 64):
        assert (golomb.decode(golomb.encode(small, 0, m), len(small), 0, m) == small).all()


def jaccard_components(rows: list[tuple], n: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            m = len(sets[a] & sets[b])
            if a < b and m and 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, empty, odd, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, words=n, percent=percent).collect()}
    assert got == jaccard_components(corpus(), n, percent)
    if n == 3:
        assert ngram_join.near_duplicates(empty).collect() == []
        assert ngram_join.near_duplicates(odd).count() == odd.count()
        kept = ngram_join.keep_one_of_each(docs, words=n, percent=percent)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 103: 100, 105: 100}


def repeats(rows: list[bytes], length: int) -> list[tuple[bytes, int, int]]:
    seen = Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(gone), spans))
    return out


@pytest.mark.parametrize("hot_kinds", [1, 2, 256])
def test_suffix_dedup(docs, empty, odd, hot_kinds):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, hot_kinds=hot_kinds).collect()}
    want = dict(zip(texts(), repeats([t.encode() for t in texts().values()], 200), strict=True))
    for i, (kept, removed, spans) in want.items():
        r = got[i]
        assert (bytes(r["kept"]), r["n_removed"], r["n_spans"], r["kept_sha256"]) == (kept, removed, spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(empty).collect() == []
    rows = [(r["text"] or "").encode() for r in odd.collect()]
    found = sorted((bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(odd, hot_kinds=hot_kinds).collect())
    assert found == sorted(repeats(rows, 200))


def test_suffix_order():
    rng = np.random.default_rng(2)
    for n, letters in ((1, 2), (60, 2), (300, 3), (400, 1)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        order = suffix_array.sort_suffixes(text, np.ones(n, bool), n + 1)
        raw = text.tobytes()
        assert sorted(order.tolist()) == list(range(n))
        shared = suffix_array.adjacent_prefixes(text, order, 20)
        for k, (a, b) in enumerate(zip(order, order[1:], strict=False), 1):
            assert raw[a:] < raw[b:] or letters == 1
            common = next((j for j in range(21) if j == 20 or raw[a + j : a + j + 1] != raw[b + j : b + j + 1] or a + j >= n or b + j >= n), 20)
            assert shared[k] == common


def seen_windows(rows: list[tuple], window: int) -> dict[int, tuple[int, int, str]]:
    split = {r[0]: (r[1] or "").encode().split() for r in rows}
    first: dict[tuple, int] = {}
    for i in sorted(split):
        for j in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][j : j + window]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("batches", "hot_kinds"), [(1, 256), (6, 256), (3, 1), (1, 2)])
def test_substring_index(docs, empty, odd, batches, hot_kinds):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_index.remove_seen_windows(docs, batches=batches, hot_kinds=hot_kinds).collect()}
    assert got == seen_windows(corpus(), 50)
    if batches == 1:
        assert substring_index.remove_seen_windows(empty).collect() == []
        assert substring_index.remove_seen_windows(odd).count() == odd.count()


def test_mixing(docs, empty, odd):
    rows = mixing.mix_to_targets(docs).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_to_targets(docs).collect()), key=str)
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(t.encode().split()) for i, t in texts().items()}
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        smallest = min(r["size"] for r in mine if r["size"])
        largest = max(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(smallest, largest / 2)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert mixing.mix_to_targets(empty).collect() == []
    assert mixing.mix_to_targets(odd).count() == odd.count()
    expanded = mixing.expand_mix(docs)
    assert expanded.columns == docs.columns
    assert expanded.count() == sum(r["copies"] for r in rows)


def test_source_targets_cap():
    import pandas as pd

    out = mixing.source_targets(pd.DataFrame({"source": ["b", "a", None], "source_size": [1000, 10, 90]}))
    assert out["source"].tolist()[:2] == ["a", "b"] and out["source"].iloc[2] is None
    assert out["target"].tolist() == pytest.approx([30, 800, 270])


TOKENIZER = "word_bpe_49k.json"


def test_packing(docs, empty, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(TOKENIZER)
    exact = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    want = {}
    for i, t in texts().items():
        ids = [*exact.encode(t, add_special_tokens=False).ids, 0]
        for j, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[(i, j)] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty, path).collect() == []
    assert len({(r["sequence_id"], r["offset"]) for r in packing.pack_documents(odd, path).collect()}) == packing.token_pieces(odd, path).count()


def test_word_ids_are_exact():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(TOKENIZER)
    exact, r = Tokenizer.from_file(path), random.Random(1)
    parts = ["a", "B", "'s", "it's", "<|endoftext|>", "<|", "é", "E\u0301", "\u0301", "1", "23", "..", ",", "*&%", " ", "  ", "\n", "\u00a0", "中", "🙂", "Σ", "ς", "İ", "<", "\u0338", "'LL", "`", "Tion"]
    for pool in ([p for p in parts if "<|" not in p], parts):
        lines = ["".join(r.choice(pool) for _ in range(r.randint(0, 20))) for _ in range(600)]
        known = packing.WordIds(path)
        ids, at = known.ids(*known.split(pa.array(lines)), 0)
        for t, a, b in zip(lines, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == [*exact.encode(t, add_special_tokens=False).ids, 0]


def test_bin_completion():
    rng = np.random.default_rng(3)
    counts = Counter(rng.integers(1, 101, 500).tolist())
    plan = packing.plan_bins(counts, 100)
    used: Counter = Counter()
    for times, pattern in plan:
        assert sum(a * n for a, n in pattern) <= 100
        for a, n in pattern:
            used[a] += n * times
    assert used == counts
    assert sum(t for t, _ in plan) <= 1.05 * -(-sum(a * n for a, n in counts.items()) // 100)
    assert packing.complete_bin(np.bincount([6, 5, 5], minlength=11), 10, 10) == [(5, 2)]


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(0, 420)]
    rows += [(500, [0.5] * 8), (501, [0.5] * 8), (600, None), (700, [float("nan")] * 8), (800, [None] * 8), (900, [1.0, 2.0]), (None, [1.0] * 8), (1000, [])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, id string, block int")
    got = topk_search.top_k(df, k=10).collect()
    usable = {i: np.pad(np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64), (0, 8 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in usable if i % 100 == 0):
        best = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.top_k(df.limit(0)).collect() == []


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block")]


def test_url_filter(spark):
    pages = [(1, "http://EXAMPLE.com/en/7x?q"), (2, "https://a.b.com/en/"), (3, "com/en/"), (4, None), (5, "http://example.net/de/8"), (6, "http://examplecom/en/"), (6, "http://x.net/de/1#f"), (7, "a://com?/en/"), (8, "http://com/EN/"), (None, "http://www.example.com/en/6" + "y" * 5000)]
    df = spark.createDataFrame([(*p, "h", "r") for p in pages], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = sorted((r["page_id"] or 0, r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect())
    assert got == sorted([(1, "example.com", "example.com/en/7", "allow"), (2, "a.b.com", "com/en/", "block"), (3, "", None, "allow"), (4, "", None, "allow"), (5, "example.net", "example.net/de/8", "block"), (6, "examplecom", None, "allow"), (6, "x.net", "net/de/", "allow"), (7, "com", None, "allow"), (8, "com", None, "allow"), (0, "www.example.com", "com/en/", "block")])
    assert url_filter.judge_urls(df.limit(0), rules).collect() == []
    assert {r["verdict"] for r in url_filter.judge_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_end|>", "<\\\\|im_end|>", "</s>[INST] ok [/INST]", "<<s>", "\\", "", None, "a\nb", "<|im_start|>user<|im_sep|>hi"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "first"), (2, 1, None, "x"), (None, None, "user", "y"), (3, 5, "tool<|im_sep|>", "z"), (3, 5, "tool<|im_sep|>", "z")]
    chats = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, state int")
    made = chat_format.format_chats(chats)
    back = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    for c in (1, 2, 3, None):
        turns = sorted((r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [t[1:] for t in turns]
        assert back[c]["loss_texts"] == [t[2] for t in turns if t[1] == "assistant"]
    assert {c: r["valid"] for c, r in back.items()} == {1: True, 2: False, 3: False, None: False}
    assert chat_format.format_chats(chats.limit(0)).collect() == []


def test_quality(spark, docs, empty, odd):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(WORDS) + "%%%" for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), f"h{i % 4}", "en" if i % 2 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = df.filter("doc_id < 200").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    got = {x["doc_id"]: x for x in quality.classify(df, labels).collect()}
    assert all(got[i]["keep"] == (i % 3 != 0) for i in range(200, 400))
    assert all(0 < x["path_rate"] < 1 for x in got.values())
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()
    assert quality.classify(odd, labels).count() == odd.count()
    assert quality.classify(empty, labels).collect() == []
