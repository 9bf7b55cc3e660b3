import random

import numpy as np
import xxhash

from quirelake.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, root long"


def brute(rows, radius=4):
    prints = [S.fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)


def near_copies(n, seed):
    r = random.Random(seed)
    base = [[r.choice("abcdefgh") + str(r.randint(0, 300)) for _ in range(r.randint(1, 150))] for _ in range(n // 5)]
    out = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = "x" + str(r.randint(0, 9))
        out.append((i, " ".join(words)))
    return out


def check(spark, rows, **more):
    frame = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = sorted((tuple(x) for x in S.simhash_dedup(frame, **more).collect()), key=repr)
    assert got == brute(rows)


def test_fingerprint_by_hand():
    words = "the cat sat on A mat".lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(3)]
    assert S.fingerprint("The cat\tsat on\n A mat") == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) > 1.5)
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0
    assert S.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_near_mask_against_popcount():
    r = np.random.default_rng(1)
    block = r.integers(0, 2**63, 300).astype(np.uint64)
    block[100:200] = block[0] ^ (np.uint64(1) << r.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 100).astype(np.uint64))
    queries = np.concatenate([block[:3], block[150:155], ~block[:2]])
    for radius in (0, 1, 3, 4, 7, 12, 30):
        want = np.bitwise_count(queries[:, None] ^ block[None, :]) <= radius
        assert (S.near_mask(S.planes_of(block), queries, radius)[:, :300] == want).all()


def test_against_brute_force(spark):
    check(spark, near_copies(400, 3))


def test_groups_split_into_cells(spark):
    rows = near_copies(300, 5)
    frame = spark.createDataFrame([(S.fingerprint(t) - (1 << 64 if S.fingerprint(t) >> 63 else 0),) for _, t in rows], "fp long").distinct()
    whole = {frozenset(x) for x in components_of(S.links(frame).collect())}
    assert whole == {frozenset(x) for x in components_of(S.links(frame, cell=4).collect())}


def test_more_blocks_give_the_same_links(spark):
    frame = spark.createDataFrame([(S.fingerprint(t) - (1 << 64 if S.fingerprint(t) >> 63 else 0),) for _, t in near_copies(300, 8)], "fp long").distinct()
    whole = components_of(S.links(frame).collect())
    assert all(components_of(S.links(frame, agree=c).collect()) == whole for c in (3, 4))
    assert [S.blocks_that_agree(n, 4, 4096) for n in (10**6, 10**10, 10**12)] == [2, 3, 4]


def components_of(links):
    groups = {}
    for a, b in links:
        merged = groups.get(a, {a}) | groups.get(b, {b})
        for x in merged:
            groups[x] = merged
    return {frozenset(x) for x in groups.values()}


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, " \t"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "q r s t u v"), (9, "w " * 50000)])
    check(spark, [(None, "only nulls here today")])
    assert S.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def sets_alike(r, a, b, both):
    """Two sets of a and b random hashes that share `both`."""
    found = r.integers(0, 2**64, a + b - both, dtype=np.uint64)
    return np.sort(found[:a]), np.sort(found[a - both :])


def test_set_print_and_labels_against_popcount():
    r = np.random.default_rng(2)
    one = r.integers(0, 2**64, 9, dtype=np.uint64)
    bits = [[int(h) >> k & 1 for k in range(64)] for h in S.mixed(one[:, None] ^ S._SALTS).ravel().tolist()]
    ones = np.array(bits).reshape(9, 256).sum(0)
    assert (S.bits_of(S.set_print(one)[None])[0] == (ones > 4.5)).all()
    prints = np.array([S.set_print(x) for _ in range(90) for x in sets_alike(r, 20, 22, int(r.integers(8, 20)))])
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2, dtype=int)
    for radius in (0, 40, 80, 100):
        assert (S.near_mask(S.planes_of(prints), prints, radius)[:, : len(prints)] == (apart <= radius)).all()
        reach = apart <= radius
        while not (reach == (wider := reach.astype(int) @ reach > 0)).all():
            reach = wider
        assert (S.near_labels(prints, radius) == reach.argmax(1)).all()


def test_sets_of_similarity_0_8_share_a_table():
    r = np.random.default_rng(4)
    for a, b, both in ((4, 5, 4), (9, 9, 8), (12, 15, 12), (13, 14, 12), (90, 90, 80), (400, 500, 400)):
        pairs = np.array([[S.set_print(x) for x in sets_alike(r, a, b, both)] for _ in range(400)])
        assert np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]).sum(1, dtype=int).max() <= S.RADIUS
        for k in (0, 5, 8):
            places = S.key_bits(k)[: None if a <= S.FEW else S.tables_for(k, S.P_DIFFERS)]
            assert (S.key_values(pairs[:, 0], places) == S.key_values(pairs[:, 1], places)).any(1).all()


def test_groups_of_tables_and_cells(spark):
    r = np.random.default_rng(6)
    sets = [x for _ in range(60) for x in sets_alike(r, 45, 45, 40)] + [x for _ in range(30) for x in sets_alike(r, 4, 5, 4)]
    one = r.integers(0, 2**64, 60, dtype=np.uint64)
    sets += [np.append(one[:58], r.integers(0, 2**64, 2, dtype=np.uint64)) for _ in range(40)]  # a large group of near copies
    prints = [S.set_print(x).view(np.int64).tolist() for x in sets]
    frame = spark.createDataFrame([(i, p, len(x) <= S.FEW) for i, (p, x) in enumerate(zip(prints, sets))], "fp long, bits array<long>, few boolean").cache()
    assert len(S.key_bits(8)) > S.tables_for(8, S.P_DIFFERS) > S.ROUND  # two rounds
    for more in ({}, {"bucket": 40}, {"cell": 32}, {"bucket": 1}):
        groups = {}
        for key, fp, hub, near in S.near_groups(frame, **more).collect():
            groups.setdefault((key, hub), set()).add(fp)
            assert near == (sum(((x ^ y) % 2**64).bit_count() for x, y in zip(prints[fp], prints[hub])) <= S.RADIUS)
        assert all(min(x) == hub and len(x) > 1 for (_, hub), x in groups.items())
        assert all(any({i, i + 1} <= x for x in groups.values()) for i in range(0, 180, 2))
        assert all(any({i, j} <= x for x in groups.values()) for i in range(180, 220) for j in range(180, i))
    assert S.near_groups(frame.limit(0)).count() == 0
