import itertools
import random
import zlib

import pytest

from loomspan.llm import shards


def least_capacity(sizes, k):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid, used, n = (low + high) // 2, 0, 1
        for s in sizes:
            if used + s > mid:
                n, used = n + 1, 0
            used += s
        low, high = (low, mid) if n <= k else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(12))
def test_minimax_against_brute_force(seed):
    """Cuts made from prefix sums alone reach the least possible largest shard."""
    rng = random.Random(seed)
    groups = {f"{rng.getrandbits(64):016x}": rng.choice([1, 5, rng.randrange(1, 400)]) for _ in range(rng.choice([0, 1, 3, 40, 700]))}
    k = rng.choice([1, 2, 5, 16])

    def sums(prefixes, width):
        out = {}
        for p in prefixes:
            by = {}
            for d, s in sorted(groups.items()):
                if d.startswith(p):
                    by.setdefault(d[:width(p)], []).append(s)
            out[p] = [shards.Segment(x, sum(v), len(v) == 1) for x, v in by.items()]
        return out

    cuts, capacity = shards.plan_cuts(sums([""], lambda p: 1)[""], k, lambda ps: sums(ps, lambda p: len(p) + 2))
    assert len(cuts) == k - 1 and cuts == sorted(cuts)
    loads = [0] * k
    for d, s in groups.items():
        loads[sum(d >= c for c in cuts)] += s
    ordered = [groups[d] for d in sorted(groups)]
    assert max(loads) == least_capacity(ordered, k) == capacity


def check(rows, corpus, n):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and all(0 <= s < n for s in by)
    group = {}
    for r in rows:
        group.setdefault(r.digest, set()).add(r.shard)
    assert all(len(v) == 1 for v in group.values())


def test_documents(docs, corpus, empty, odd, spark):
    rows = shards.shard_by_bytes(docs, 4).collect()
    check(rows, corpus, 4)
    texts = dict(corpus)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert shards.shard_by_bytes(empty, 4).collect() == []
    check(shards.shard_by_bytes(odd, 4).collect(), None, 4)
    assert shards.shard_by_bytes(odd, 4).count() == 6


def test_one_large_group(spark):
    rows = [(i, "same text " * 30) for i in range(200)] + [(1000 + i, f"text {i} " * 9) for i in range(300)]
    got = shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check(got, None, 8)
    loads = sorted(sum(r.size for r in v) for _, v in itertools.groupby(sorted(got, key=lambda r: r.shard), key=lambda r: r.shard))
    assert len(loads) == 8 and loads[-2] - loads[0] <= 2 * 100
