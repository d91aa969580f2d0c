import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import chat, decontaminate, pii
from latticework.llm.queries import op5_pii_contexts

from .conftest import words


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_decontamination_matches_exact_containment(spark, docs):
    rng = random.Random(1)
    items = [words(rng, n, 2000) for n in (3, 4, 5, 6, 8, 12, 20, 33, 64, 120, 300)]
    texts = [words(rng, rng.randint(0, 400), 2000) for _ in range(30)]
    for item in items:
        for cut in (1.0, 0.9, 0.7):
            w = item.split()
            w = w[: max(1, int(len(w) * cut))]
            texts.append(words(rng, rng.randint(0, 3000), 2000) + " " + " ".join(w).upper() + "\n" + words(rng, 50, 2000))
    texts += [None, "", items[4], words(rng, 40_000, 100)]
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    want = {(d, i, len(shingles(t) & shingles(x))) for d, t in enumerate(texts) for i, x in enumerate(items) if shingles(x) and len(shingles(t) & shingles(x)) >= 0.8 * len(shingles(x)) - 1e-9}
    for chunk in (decontaminate.CHUNK_BYTES, 200):
        got = decontaminate.contaminated(docs(texts), bench, chunk_bytes=chunk)
        assert {(r.doc_id, r.item_id, r.matched) for r in got.collect()} == want
    kept = decontaminate.drop_contaminated(docs(texts).withColumnRenamed("lang", "item_id"), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, *_ in want}
    assert decontaminate.contaminated(docs([]), bench).collect() == []
    assert decontaminate.contaminated(docs(texts), bench.limit(0)).collect() == []


def test_hashes_tell_shingles_apart():
    line = decontaminate.normal(words(random.Random(2), 3000, 50).encode())
    h = decontaminate.shingle_hashes(line)
    w = line.split()
    by = defaultdict(set)
    for k, x in enumerate(h.tolist()):
        by[x].add(tuple(w[k : k + 5]))
    assert len(h) == len(w) - 4 and all(len(v) == 1 for v in by.values()) and len(by) == len(set(zip(*(w[k:] for k in range(5)))))


def brute_chat(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    full = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in convs.items()}
    return sorted(c for c, v in full.items() if not any((len(w) > len(v) and w[: len(v)] == v) or (w == v and d < c) for d, w in full.items()))


def test_snapshots_collapse_to_maximal_conversations(spark):
    rng = random.Random(3)
    rows, turns = [], [("user" if k % 2 == 0 else "assistant", words(rng, 3, 5)) for k in range(3000)]
    for c in range(40):
        start = rng.choice((0, 0, 0, 7))
        n = rng.randint(1, 6)
        rows += [(c, 10 * k, *turns[start + k]) for k in range(n)]
    rows += [(100, k, *turns[k]) for k in range(3000)] + [(101, None, None, None), (102, None, None, None), (103, 0, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (4, 1024):
        got = chat.render(frame.withColumn("position", frame.turn), block)
        assert sorted({r.conv_id for r in got.collect()}) == brute_chat(rows)
    long = sorted((r.position, r.rendered) for r in got.where("conv_id = 100").collect())
    assert [p for p, _ in long] == list(range(1, 3001)) and long[1][1] == f"<|{turns[1][0]}|>\n{turns[1][1]}<|end|>\n"
    assert chat.render(frame.limit(0)).collect() == []


# As the contract has the forms, without the guards of the engine's patterns.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return True


def plain_spans(t):
    found = [(m.start(), n, m.end()) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t or "") if valid(k, m[0])]
    return sorted(found)


def test_base_spans_match_plain_patterns(spark, docs):
    rng = random.Random(6)
    bits = ["é", "😀", "a.b+c@d-e.fg", "x@y", "@", "1.2.3.4", "256.1.1.1", "0255.1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (974) 555-3436", "+49 30 1234567", "+", " ", "  ", "\n", ".", "_", "-", "7", "word", "a@b.c_d@e.f", "x@y.z.foo@bar.com"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [None, "", "9" * 60_000, "a" * 60_000, "1.2.3.4 " * 3000, "a@" * 20_000, "+1" + "(" * 30_000]
    got = {r.doc_id: r for r in pii.find(docs(texts)).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in got[i].base] == plain_spans(t), t
        assert {(s.start, s.kind, s.end) for s in got[i].spans} >= {(s.start, s.kind, s.end) for s in got[i].base}


def luhn(prefix):
    return next(prefix + str(d) for d in range(10) if valid("card", prefix + str(d)))


def test_contexts_discover_and_leave_other_numbers(docs):
    rng = random.Random(7)
    card = lambda: luhn("".join(str(rng.randrange(10)) for _ in range(15)))
    texts = [f"please charge card number {card()} today {words(rng, 5)}" for _ in range(12)]
    texts += [f"the order code {rng.randrange(10**15, 10**16)} was sent" for _ in range(12)]
    typo = "4111111111111112"
    texts.append(f"so charge card number {typo} now")
    twin = card()
    texts += [f"see {twin} there", f"first {twin} {card()} both"]
    got = {r.doc_id: [(s.kind, s.match) for s in r.spans] for r in pii.find(docs(texts)).collect()}
    assert got[24] == [(2, typo)]
    assert (2, twin) in got[26]
    assert all(not any(m not in t or not valid("card", m) for _, m in got[k]) for k, t in enumerate(texts) if 12 <= k < 24)
    cleaned = {r.doc_id: r.text for r in pii.redact(docs(texts).withColumnRenamed("lang", "more")).collect()}
    assert cleaned[24] == "so charge card number <card> now"


def test_numbers_written_with_blanks_are_discovered(docs):
    rng = random.Random(8)
    texts = [f"please call +1 (974) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)} today" for _ in range(40)]
    texts += [f"please charge card number {luhn(''.join(str(rng.randrange(10)) for _ in range(15)))} today" for _ in range(40)]
    numbers = ["(974) 555-3436", "974 555 3436", "030 1234567", "974-555-3437"]
    texts += [f"please call {n} today" for n in numbers]
    texts += ["please charge card number 4111 1111 1111 1112 today", "the years 1990 1991 1992 1993 passed", "please call 974-555-3438 3rd time"]
    got = {r.doc_id: [(s.kind, s.match) for s in r.spans] for r in pii.find(docs(texts)).collect()}
    assert [got[80 + k] for k in range(4)] == [[(3, n)] for n in numbers]
    assert got[84] == [(2, "4111 1111 1111 1112")] and got[85] == [] and got[86] == [(3, "974-555-3438")]


def test_pii_counts_are_of_their_kinds(spark, docs, tmp_path):
    texts = ["a@b.cd", "1.2.3.4 and 5.6.7.8", "4111 1111 1111 1111", "+1 212 555 0100", "x@y.zz 1.2.3.4 c@d.ef 300.1.1.1 g@h.ij", "none", "", None]
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:5] for r in op5_pii_contexts(spark, str(tmp_path)).collect()}
    want = [(1, 0, 0, 0), (0, 2, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (3, 1, 0, 0), *[(0, 0, 0, 0)] * 3]
    assert got == dict(enumerate(want))


def test_pii_of_odd_rows(spark, docs):
    assert pii.find(docs([])).collect() == []
    got = pii.find(docs(["a@b.cd", "a@b.cd", "1.2.3.4", None], ids=[1, 1, 1, None])).collect()
    assert sorted((r.doc_id or -1, len(r.base)) for r in got) == [(-1, 0), (1, 1), (1, 1), (1, 1)]
    out = op5_pii_contexts(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=40))
def test_bands_never_miss_an_item_itself(values):
    item = " ".join(f"v{v}" for v in values).encode()
    index = decontaminate.Index([(1, item)])
    found = index.search(b"before and after " + item + b" the end")
    assert bool(found) == (len(values) >= 5) and np.all([m == n for _, m, n in found])


def test_redaction_goes_by_row(spark, docs):
    texts = ["x ann@example.org is another", "write to bob.long.name@example.org or +1 (974) 555-3436", "no id: eve@example.org", "no id either, and none", None, "", "both +378282246310005 ends"]
    frame = docs(texts, ids=[1, 1, None, None, 1, 1, 2]).withColumnRenamed("lang", "spans").withColumnRenamed("source", "base")
    twice = frame.unionAll(frame.limit(1))
    got = sorted((r.doc_id or -1, r.text or "", r.text is None) for r in pii.redact(twice).collect())
    clean = ["x <email> is another", "write to <email> or <phone>", "no id: <email>", "no id either, and none", None, "", "both <phone> ends"]
    want = sorted((i or -1, t or "", t is None) for i, t in zip([1, 1, None, None, 1, 1, 2, 1], [*clean, clean[0]], strict=True))
    assert got == want and pii.redact(frame).columns == frame.columns
    assert pii.redact(docs([])).collect() == []


def test_contexts_of_long_words_and_gaps(docs):
    rng = random.Random(12)
    card = lambda: luhn("".join(str(rng.randrange(10)) for _ in range(15)))
    for word in ("k" * 30, "k" * 79, "k" * 200, "k" * 5000):
        texts = [f"please {word} {card()} today" for _ in range(12)]
        texts += [f"please {word}{'j'} {rng.randrange(10**15, 10**16)} sent" for _ in range(12)]
        texts += [f"please {word}     4111111111111112 now", f"please {word}j 4111111111111112 now"]
        got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(docs(texts)).collect()}
        assert got[24] == [2], len(word)


def test_scores_match_a_plain_walk_over_the_graph(spark):
    rng = random.Random(13)
    edges = sorted({(f"p{rng.randrange(12)}", f"i{rng.randrange(40)}") for _ in range(160)})
    counted = {e: rng.random() < 0.8 for e in edges}
    seeds = {(f"i{k}", k % 2) for k in range(0, 40, 2)}
    known = {s: 1.0 for s in seeds}
    scores = dict(known)
    for _ in range(3):
        conf = {}
        for p in {p for p, _ in edges}:
            own = [i for q, i in edges if q == p and counted[q, i]]
            for kind in (0, 1):
                weight = sum(scores.get((i, kind), 0.0) for i in own)
                if own and weight >= 2 and weight / (len(own) + 0.5) >= 0.3:
                    conf[p, kind] = weight / (len(own) + 0.5)
        scores = dict(known)
        for i in {i for _, i in edges}:
            for kind in (0, 1):
                left = [1 - conf[p, kind] for p, j in edges if j == i and (p, kind) in conf]
                if left and (i, kind) not in known:
                    scores[i, kind] = 1 - float(np.prod(left))
    frame = spark.createDataFrame([(p, i, counted[p, i]) for p, i in edges], "pattern string, instance string, counted boolean")
    got = pii.score_instances(frame, spark.createDataFrame(sorted(seeds), "instance string, kind int"), 3, 2, 0.3)
    got = {(r.instance, r.kind): r.score for r in got.collect()}
    assert got.keys() == scores.keys() and all(abs(got[k] - scores[k]) < 1e-9 for k in scores)


def test_contaminated_rows_go_by_text(spark, docs):
    rng = random.Random(14)
    items = [words(rng, n, 3000) for n in (16, 16, 40)]
    bench = spark.createDataFrame([(None if k == 1 else k, t) for k, t in enumerate(items)], "item_id long, text string")
    texts = [items[0], "an unrelated text of a repeated id, quite clean", items[1] + " more", None, "", words(rng, 3000, 50) + " " + items[2], "clean too"]
    frame = docs(texts, ids=[1, 1, None, None, 2, 3, 3]).withColumnRenamed("lang", "_found").withColumnRenamed("source", "t1")
    for limit in (decontaminate.CHUNK_BYTES, 1):
        kept = decontaminate.drop_contaminated(frame, bench, chunk_bytes=limit)
        assert kept.columns == frame.columns
        assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(1, texts[1]), (-1, ""), (2, ""), (3, texts[6])])
    assert decontaminate.drop_contaminated(frame, bench.limit(0)).count() == len(texts)
    assert decontaminate.drop_contaminated(frame.limit(0), bench).collect() == []


def test_an_index_stays_near_its_estimate():
    import tracemalloc

    rng = random.Random(15)
    items = [(k, words(rng, 16, 10**6).encode()) for k in range(3000)]
    told = sum(decontaminate.index_bytes(t) for _, t in items)
    decontaminate.Index(items[:10])
    tracemalloc.start()
    index = decontaminate.Index(items)
    took, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < told + (4 << 20) and peak < 3 * told + (8 << 20)
    assert all(index.search(b"so " + t + b" then") == [(k, 12, 12)] for k, t in items[::100])


def test_tied_turns_are_ordered_as_in_the_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(16)
    rows = []
    for c in range(60):
        n = rng.randint(1, 6)
        rows += [(c, rng.choice((0, 1, 1, 2, None, -1)), rng.choice(("user", "tool", None)), rng.choice(("a", "b", "B", "é", "", None))) for _ in range(n)]
    rows += rows[:20] + [(None, 1, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "c"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = sorted(db.execute(chat.ORACLE).fetchall())
    for block in (1, 1024):
        assert sorted(map(tuple, chat.render(frame, block).collect())) == want
