import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.graph import components


def slow_print(text, shingle):
    import re
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs, nodes):
    up = {n: n for n in nodes}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {n: find(n) for n in nodes}


def slow_groups(rows, shingle, bits):
    fps = [slow_print(t, shingle) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    root = roots(pairs, range(len(rows)))
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[n] and rows[m][0] is not None]
        out.append((i, f"{fps[n]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5])
def test_groups_match_brute_force(docs, bits):
    rng = random.Random(bits)
    words = [f"w{i}" for i in range(40)] + ["É", "Kİ", "naïve"]
    rows = []
    for i in range(60):
        base = rng.choices(words, k=rng.choice([0, 1, 2, 3, 8, 400]))
        for c in range(rng.choice([1, 1, 4])):
            near = [w if rng.random() > 0.01 * c else rng.choice(words) for w in base]
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(near)))
    rows += [(900, None), (901, ""), (902, " \n\x0b"), (None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1]), (903, "A B C"), (904, "a b c")]
    got = simhash.simhash_groups(docs(rows).withColumn("fp", F.lit(1)).withColumn("part", F.lit("x")), max_bits=bits)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == slow_groups(rows, 3, bits)


def test_dense_fingerprints(spark):
    """Groups of fingerprints given directly, so that distances of 1 to 4 bits all occur."""
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6]))) for _ in range(25)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "id bigint, fp bigint")
    old, simhash.fingerprints = simhash.fingerprints, lambda *a: frame
    try:
        got = {r["id"]: r["component_id"] for r in simhash.simhash_groups(None, "id").collect()}
    finally:
        simhash.fingerprints = old
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert got == roots(pairs, range(len(fps)))


def test_exploded_keys_are_not_broadcast(docs, monkeypatch):
    """68 keys per fingerprint stand under a size taken for one: the planner must not be free to send them to the driver."""
    linked = []
    monkeypatch.setattr(simhash, "components", lambda edges: linked.append(edges) or components(edges))
    rows = [(i, f"{'the house by the lake ' * 9}{i}") for i in range(20)] + [(20 + i, f"tree {i} stands at {i * i} by {i * 7}") for i in range(20)]
    got = simhash.simhash_groups(docs(rows))
    assert sorted(map(tuple, got.collect()), key=repr) == slow_groups(rows, 3, 3)
    links, result = (frame._jdf.queryExecution().sparkPlan().toString() for frame in (linked[1], got))
    assert links.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in links
    assert "SortMergeJoin [fp" in result and "BroadcastHashJoin [fp" not in result


def test_empty_and_long(docs):
    assert simhash.simhash_groups(docs([])).count() == 0
    long = "lorem ipsum dolor " * 60_000
    got = simhash.simhash_groups(docs([(1, long), (2, long + "x")])).collect()
    assert {r["component_id"] for r in got} == {1} and got[0]["fingerprint"] == f"{slow_print(long, 3):016x}"


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    names = list(range(300))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(120)] + [(names[200], names[i]) for i in range(201, 260)] + [(7, 7), (None, 3), (3, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == roots(real, {x for e in real for x in e})
