"""Bin completion against the exact least waste, on tables of few lengths."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidewright.llm import packing, queries


def least_waste(counts, room):
    reached = {0}
    for a, n in counts.items():
        for _ in range(n):
            reached |= {x + a for x in reached if x + a <= room}
    return room - max(reached)


def waste(counts, room, **options):
    table = np.zeros(2049, np.int64)
    table[list(counts)] = list(counts.values())
    filled = packing.complete_bin(table, room, 2048, **options)
    assert all(n <= counts[a] for a, n in filled)
    return room - sum(a * n for a, n in filled)


def test_swap_of_larger_pieces():
    counts = {44: 2, 101: 3, 179: 2, 210: 5, 324: 4, 350: 5, 374: 3, 379: 2, 410: 1, 412: 5, 454: 3, 458: 1}
    assert waste(counts, 1447) == least_waste(counts, 1447) == 0


def test_pruning_loses_no_least_waste():
    r = random.Random(2)
    for _ in range(80):
        room = r.randrange(100, 1500)
        counts = {r.randrange(5, 500): r.randrange(1, 6) for _ in range(r.randrange(1, 12))}
        assert waste(counts, room, nodes=10**6) == least_waste(counts, room)


def least_bins(pieces, capacity):
    """Fewest bins by all subsets: (bins, room used in the last) of each."""
    best = [(0, capacity)] + [(len(pieces) + 1, 0)] * ((1 << len(pieces)) - 1)
    for s in range(1, 1 << len(pieces)):
        for i, a in enumerate(pieces):
            if s >> i & 1:
                bins, used = best[s ^ 1 << i]
                best[s] = min(best[s], (bins, used + a) if used + a <= capacity else (bins + 1, a))
    return best[-1][0]


def test_plans_of_few_pieces_are_least():
    r, beaten = random.Random(5), 0
    for _ in range(150):
        pieces = [r.randrange(20, 70) for _ in range(r.randrange(1, 12))]
        table = np.bincount(pieces, minlength=101)
        plan = packing.plan_bins(Counter(pieces), 100)
        used = Counter()
        for times, pattern in plan:
            assert sum(a * n for a, n in pattern) <= 100
            for a, n in pattern:
                used[a] += n * times
        bins, exact = sum(times for times, _ in plan), least_bins(pieces, 100)
        assert used == Counter(pieces)
        assert packing.fewest_bins(table, 100) <= exact == bins
        beaten += sum(times for times, _ in packing._best_fit_plan(table, 100)) > exact
    assert beaten > 0  # some need the search


def test_second_plan_is_needed():
    # Some tables need another filling than the least wasteful.
    r, found = random.Random(6), 0
    for _ in range(400):
        pieces = [r.randrange(15, 60) for _ in range(11)]
        first = sum(times for times, _ in packing.plan_bins(Counter(pieces), 100, 1))
        found += first > sum(times for times, _ in packing.plan_bins(Counter(pieces), 100))
    assert found > 0


def test_other_tokenizers_take_whole_texts():
    path = queries.tokenizer_path("byte_bpe_50k.json")
    exact, known = Tokenizer.from_file(path), packing.WordIds(path)
    assert not known.by_word and packing.WordIds(queries.tokenizer_path()).by_word
    for texts in (["Two  Words", "", " x\n", "Two  Words"], ["<|endoftext|> a"], []):
        ids, at = known.ids(*known.split(pa.array(texts, pa.string())), 0)
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == [*exact.encode(t, add_special_tokens=False).ids, 0]
