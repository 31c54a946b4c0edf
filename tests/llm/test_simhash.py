"""SimHash fingerprints, Golay keys and components against brute force."""

import numpy as np
import pytest
import xxhash
from odd import TEXTS, empty, odd, rows

from labelprism.llm import queries, simhash
from tests.conftest import SF_SMALL


def brute_fingerprint(text, shingle=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[k: k + shingle]) for k in range(max(len(words) - shingle + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(nodes, bits=3):
    """Root of each value: union by pairs."""
    nodes = sorted(set(nodes))
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for k, a in enumerate(nodes):
        for b in nodes[k + 1:]:
            if (a ^ b).bit_count() <= bits:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def brute(texts):
    fps = [(i, brute_fingerprint(t)) for i, t in texts]
    roots = brute_components([f for _, f in fps])
    low = {}
    for i, f in fps:
        if i is not None:
            low[roots[f]] = min(i, low.get(roots[f], i))
    return sorted(((i, f"{f:016x}", low.get(roots[f])) for i, f in fps), key=repr)


def test_decoder_is_the_perfect_code():
    table = simhash.decoder()
    assert np.bincount(table.astype(np.int64), minlength=4096).tolist() == [2048] * 4096
    words = np.flatnonzero(table == 0)
    assert max(int(w).bit_count() for w in words) == 3


def test_every_pair_within_three_bits_shares_a_bucket():
    rng = np.random.default_rng(5)
    fps = rng.integers(-(1 << 63), (1 << 63) - 1, 400, np.int64)
    for n in (1, 2, 3):
        for f in fps:
            other = np.int64(f)
            for bit in rng.choice(64, n, replace=False):
                other = np.int64(np.uint64(other) ^ np.uint64(1 << int(bit)))
            keys, places = simhash.bucket_keys(np.array([f, other], np.int64))
            assert set(keys[places == 0]) & set(keys[places == 1])


@pytest.mark.parametrize("seed", range(2))
def test_components_of_near_fingerprints(spark, seed):
    rng = np.random.default_rng(seed)
    values = set()
    for centre in rng.integers(-(1 << 63), (1 << 63) - 1, 12, np.int64).tolist():
        at = centre
        for _ in range(rng.integers(1, 60)):  # walks make long chains, returns make dense groups
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                at ^= 1 << int(bit) if bit < 63 else -(1 << 63)
            values.add(at)
            if rng.integers(3) == 0:
                at = centre
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = dict(rows(simhash.components(simhash.golay_links(df)), "node", "root"))
    unsigned = {v & (1 << 64) - 1: v for v in values}
    want = brute_components(unsigned)
    groups = {}
    for u, r in want.items():
        groups.setdefault(r, []).append(unsigned[u])
    assert {v: got.get(v, v) for v in values} == {v: min(g) for g in groups.values() for v in g}


def test_one_bucket_of_many_unlinked_fingerprints(spark):
    """20,000 fingerprints of one bucket, four bits and more apart but for a few: block pairs, even tasks, every link found."""
    rng = np.random.default_rng(6)
    # the first segment and the second's key are equal: words of the code in the third segment lie seven bits apart
    index = rng.choice(1 << 12, 2500, replace=False)
    code = np.zeros(len(index), np.int64)
    for k in range(12):
        code ^= np.where(index >> k & 1, simhash.GENERATOR << k, 0)
    low = np.int64(0b1011)
    third = np.unique(code & (1 << 21) - 1)
    second = np.array([0, 0b1111, 0b11110000, 0b111100000000, 0b1111000011110000, 0b11111111, 0b111111110000, 0b1111000000001111], np.int64) << 22
    fps = np.unique((third[:, None] << 43 | second[None, :] | low).ravel())
    near = fps[:50] ^ 1 << 60
    members = np.unique(np.concatenate((fps, near)))
    assert len(members) > 15_000
    links = simhash.golay_links(spark.createDataFrame([(int(v),) for v in members], "fp long"), split=1000)
    got = {v: r for v, r in rows(simhash.components(links), "node", "root")}
    u = members.view(np.uint64)
    for v in near.tolist():
        linked = members[np.bitwise_count(u ^ np.array([v]).view(np.uint64)) <= 3]
        assert len({got.get(int(x), int(x)) for x in linked}) == 1 and len(linked) > 1


@pytest.mark.parametrize("split", [2, 5])
def test_buckets_in_blocks_give_the_same_components(spark, split):
    rng = np.random.default_rng(7)
    centre = 0x123456789ABCDEF
    values = {centre}
    for _ in range(150):
        at = rng.choice(list(values))
        for bit in rng.choice(62, rng.integers(1, 6), replace=False):
            at = int(at) ^ 1 << int(bit)
        values.add(int(at))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    a, b = (sorted(rows(simhash.components(simhash.golay_links(df, split=s)), "node", "root")) for s in (simhash.SPLIT, split))
    assert a == b and len(a) > 50


def test_odd_documents_and_empty_table(spark):
    got = queries_like(simhash.simhash_components(odd(spark)))
    assert got == brute(TEXTS)
    assert simhash.simhash_components(empty(spark)).collect() == []


def queries_like(df):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()), key=repr)


def test_op4_on_whole_table(spark):
    texts = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert rows(queries.op4_simhash(spark, SF_SMALL), "doc_id", "fingerprint", "component_id") == brute(texts)
