import random
from collections import Counter

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework.llm import similar, simhash

from .conftest import words


def plain_simhash(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    ones = Counter(b for x in s for b in range(64) if xxhash.xxh64_intdigest(x, 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if n * 2 > len(s))


def components(prints, linked):
    root = {k: k for k in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and linked(prints[a], prints[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in prints}


def texts_with_copies(seed=1, n=60):
    rng = random.Random(seed)
    out = [words(rng, rng.randint(1, 120)) for _ in range(n)]
    for _ in range(n // 2):
        w = rng.choice(out).split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return [*out, "", None, " \t\n", "É É é", out[0], "X" * 50_000, "long " * 30_000]


def test_fingerprints_and_components_match_brute_force(docs):
    texts = texts_with_copies()
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(docs(texts)).collect()}
    prints = {i: plain_simhash(t) for i, t in enumerate(texts)}
    tied = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == {i: (f"{prints[i]:016x}", tied[i]) for i in prints}


def test_small_shards_give_the_same_links(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(5)]
    values = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(60)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for shard in (3, 2048):
        links = {(r.a, r.b) for r in simhash.link(frame, shard=shard).collect()}
        assert all(0 < ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in links)
        of = components({k: v for k, v in enumerate(values)}, lambda a, b: (a ^ b).bit_count() <= 2)
        found = components({k: s for k, s in enumerate(signed)}, lambda a, b: (a, b) in links or (b, a) in links)
        assert of == found


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), max_size=60), st.integers(0, 2**12 - 1), st.integers(0, 4))
def test_bk_tree_finds_all_within_radius(items, probe, radius):
    tree = simhash.BKTree()
    for x in items:
        tree.add(x)
    assert sorted(tree.items[k] for k in tree.within(probe, radius)) == sorted(x for x in set(items) if (x ^ probe).bit_count() <= radius)


def test_bit_counts_agree_for_long_texts():
    import numpy as np

    h = np.random.default_rng(0).integers(0, 1 << 63, 5000, np.uint64)
    assert (simhash.bit_counts(h) == np.concatenate([simhash.bit_counts(h[k : k + 1000]) for k in range(0, 5000, 1000)]).reshape(5, 64).sum(0)).all()


def test_empty_null_and_repeated_rows(docs):
    assert simhash.near_duplicates(docs([])).collect() == []
    got = simhash.near_duplicates(docs(["a b c d", "a b c d", None], ids=[7, 7, None])).collect()
    assert sorted((r[0] is None, r[2]) for r in got) == [(False, 7), (False, 7), (True, None)]


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_similar_groups_match_exact_jaccard(docs):
    rng = random.Random(5)
    texts = texts_with_copies(3, 40)
    for _ in range(20):  # around 0.8
        w = words(rng, 100, 5000).split()
        texts.append(" ".join(w))
        for k in (20, 50):
            w[k] = "other"
        texts.append(" ".join(w))
    lower = [None if t is None else t.lower() for t in texts]
    sets = {i: shingles(t) for i, t in enumerate(lower)}
    tied = components(sets, lambda a, b: (not a and not b) or (len(a & b) >= 0.8 * len(a | b) - 1e-9 and bool(a & b)))
    got = {r[0]: r[1] for r in similar.similar_groups(docs(texts)).collect()}
    assert got == tied
    kept = similar.drop_similar(docs(texts).withColumnRenamed("lang", "rep")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i in tied if tied[i] == i)
    assert similar.similar_groups(docs([])).collect() == []


def _brute_groups(texts, similarity=0.8):
    sets = [set(similar.shingle_set(t.encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            whole = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) / whole if whole else 1.0) >= similarity - 1e-9:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(len(texts))]


def test_borderline_groups_equal_brute_force(spark):
    """Many texts whose similarities lie on both sides of 0.8."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(160)]
    texts = []
    for n in range(120):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"x{n}y{rng.randrange(9)}"
        texts.append(" ".join(words))
    want = _brute_groups(texts)
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    assert [r[1] for r in sorted(similar.similar_groups(rows).collect())] == want


def test_large_groups_are_parted_by_bands_and_chunks(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    texts = [" ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(40)] + [" ".join(f"u{n}v{k}" for k in range(50)) for n in range(10)]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    marked = similar.sketches(rows, 5)
    nodes = marked.groupBy("digest", "sim", "bands").agg(F.min("doc_id").alias("rep"))
    groups = similar.candidate_groups(nodes, shard=8)
    links = {(r.a, r.b) for r in similar.verified_links(nodes, groups, rows, 5, 0.8, shard=8).collect()}
    want, forest = _brute_groups(texts), similar.Forest()
    for a, b in links:
        forest.tie(a, b)
    assert [forest.top(n) for n in range(len(texts))] == want


def test_overlap_is_the_exact_similarity():
    rng = random.Random(3)
    sets = [similar.shingle_set(" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 60))).encode(), 2) for _ in range(30)]
    exact = similar.Overlap(sets)
    for s in sets:
        for got, t in zip(exact.jaccard(s), sets, strict=True):
            x, y = set(s.tolist()), set(t.tolist())
            assert abs(got - len(x & y) / len(x | y)) < 1e-12


def test_similar_rows_go_by_text(spark, docs):
    rng = random.Random(21)
    a, b, c = (words(rng, 60, 10**6) for _ in range(3))
    near = a.replace(a.split()[0], "else", 1)
    texts = [a, b, near, c, c, c + " end", "", None, b, a]
    frame = docs(texts, ids=[1, 1, 2, None, None, None, 9, 8, 1, None]).withColumnRenamed("lang", "rep").withColumnRenamed("source", "row").withColumnRenamed("n_chars", "id")
    kept = similar.drop_similar(frame)
    assert kept.columns == frame.columns
    rows = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    assert [r for r in rows if r[0] > 0] == sorted([(1, a), (1, b), (8, "")]) and len(rows) == 4 and rows[0][1] in (c, c + " end")
    groups = sorted((r[0] or -1, r[1] or -1) for r in similar.similar_groups(frame).collect())
    assert groups == sorted([(1, 1), (1, 1), (2, 1), (-1, -1), (-1, -1), (-1, -1), (9, 8), (8, 8), (1, 1), (-1, 1)])
    assert similar.drop_similar(frame.limit(0)).collect() == []


def test_short_texts_are_linked_exactly(docs):
    rng = random.Random(22)
    texts = []
    for _ in range(60):
        w = words(rng, rng.randint(8, 12), 10**6).split()
        texts += [" ".join(w), " ".join(w[1:]), " ".join(w[:-1]), " ".join(w[2:])]
    got = {r[0]: r[1] for r in similar.similar_groups(docs(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == _brute_groups(texts)


def test_links_do_not_depend_on_the_group_size():
    """Items within the radius and similar, which share no band: no link in a small group, as in a large one."""
    import numpy as np

    h = np.arange(100, dtype=np.uint64)
    a, b = (1, 0, h, b"\1" * 128), (2, 1, h, b"\2" * 128)
    c = (3, 1, h, b"\2" * 128)
    assert similar.forest_links([a, b], [], 64, 0.8) == [] and similar.forest_links([b, c], [], 64, 0.8) == [(3, 2)]


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    from latticework.llm import components as graph

    rng = random.Random(23)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(80)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    ends = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    linked = {frozenset(e) for e in edges}
    want = components({n: n for n in ends}, lambda a, b: frozenset((a, b)) in linked)
    for most in (100_000, 40):
        monkeypatch.setattr(graph, "TASK_EDGES", most)
        assert {r.node: r.component for r in graph.connected_components(frame).collect()} == want
    assert graph.connected_components(frame.limit(0)).collect() == []
