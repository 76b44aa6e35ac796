from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from llm_cases import texts_of
from pyspark.sql import functions as F

from tallyframe.llm import components, simhash


def plain_fingerprint(text: str, size: int = 4) -> str:
    words = [w.decode() for w in text.encode().lower().split()]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return f"{sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)):016x}"


def plain_groups(rows, distance=4):
    """Smallest id of each row's component, by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    prints = [int(p, 16) for _, p in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("run_limit", [4096, 2])
def test_groups_of_documents(documents, run_limit):
    rows = [(d, plain_fingerprint(t)) for d, t in texts_of(documents)]
    want = sorted(zip(*zip(*rows), plain_groups(rows)))
    got = simhash.simhash_groups(documents, run_limit=run_limit).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_odd_rows(odd, nothing):
    rows = [(d, plain_fingerprint(t)) for d, t in texts_of(odd)]
    want = sorted(zip(*zip(*rows), plain_groups(rows)), key=str)
    got = simhash.simhash_groups(odd).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert simhash.simhash_groups(nothing).count() == 0


def test_one_row_of_each_group_stays(odd, nothing):
    groups = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(odd).collect()}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == len(set(groups.values()))
    assert all(r.score == 1.5 and r.print == "keep" and r.row == 7 for r in rows)
    assert {r.doc_id for r in rows} == set(groups.values())
    assert simhash.keep_one(nothing).count() == 0


def random_prints(n, seed=1):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    made = set(base)
    while len(made) < n:
        value = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(1, 7)):
            value ^= 1 << b
        made.add(value)
    return sorted(made)


@pytest.mark.parametrize("run_limit", [4096, 4])
def test_links_keep_every_component(spark, run_limit):
    prints = random_prints(400)
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "print long")
    links = components.components(simhash.link_prints(frame, run_limit=run_limit)).collect()
    root = {r.node: r.root for r in links}
    got = [root.get(simhash.signed(p), simhash.signed(p)) for p in prints]
    want = plain_groups([(simhash.signed(p), f"{p:016x}") for p in prints])
    assert got == want


def test_plans_add_up():
    rng = np.random.default_rng(0)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    for n in (10, 10_000, 10_000_000, 10_000_000_000):
        plan = simhash.search_plan(n, bits.T @ bits / len(bits) * n)
        assert sum(g.threshold for g in plan) == simhash.DISTANCE - len(plan) + 1
        assert sorted(b for g in plan for b in g.bits) == list(range(64))
        assert min(g.threshold for g in plan) >= -1
    # the more fingerprints, the narrower the search: fewer groups with more bits each
    sizes = [len(simhash.search_plan(n, bits.T @ bits / len(bits) * n)) for n in (10_000, 1_000_000_000)]
    assert sizes[0] > sizes[1]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (201, 200), (200, 201)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {r.node: r.root for r in found}
    assert all(root[k] == 0 for k in range(1, 61)) and all(root[k] == 100 for k in range(101, 160)) and root[201] == 200
    none = spark.createDataFrame([], "a long, b long")
    assert components.components(none).count() == 0


def test_no_pairs_of_a_crowd_are_joined(spark):
    prints = spark.range(300).select((F.col("id") * 0).bitwiseXOR(F.pow(2.0, F.col("id") % 40).cast("long")).alias("print")).distinct()
    links = simhash.link_prints(prints, run_limit=8)
    assert links.count() <= 64 * prints.count()


def broadcast(frame):
    """The steps of the plan that ran, as far as their rows were broadcast."""
    frame.collect()
    depth, found = None, []
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    for line in final.splitlines():
        at = len(line) - len(line.lstrip(" :+-*("))
        if depth is not None and at <= depth:
            depth = None
        if depth is not None:
            found.append(line)
        elif "BroadcastExchange" in line:
            depth = at
    return found


def test_values_around_a_crowd_are_not_broadcast(spark):
    crowd = spark.createDataFrame([(simhash.signed(p),) for p in random_prints(40)], "print long")
    assert not broadcast(simhash.midpoints(crowd))


def test_crowded_keys_are_not_searched_on_the_driver(spark):
    prints = spark.createDataFrame([(simhash.signed(p),) for p in random_prints(80)], "print long")
    assert not [line for line in broadcast(simhash.link_prints(prints, run_limit=4)) if "Generate" in line]


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
@pytest.mark.parametrize("at_once", [1024, 7])
def test_midpoints_keep_every_component(spark, monkeypatch, distance, at_once):
    monkeypatch.setattr(simhash, "CROWD_AT_ONCE", at_once)
    prints = random_prints(60)
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints] * 2, "print long")
    root = {r.node: r.root for r in components.components(simhash.midpoints(frame, distance)).collect()}
    got = [root.get(simhash.signed(p), simhash.signed(p)) for p in prints]
    assert got == plain_groups([(simhash.signed(p), f"{p:016x}") for p in prints], distance)


@pytest.mark.parametrize("run_limit", [4096, 2])
def test_one_row_of_each_group_of_a_crowd_stays(documents, run_limit):
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(documents, run_limit=run_limit).collect()}
    kept = [r.doc_id for r in simhash.keep_one(documents, run_limit=run_limit).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(groups.values()))
