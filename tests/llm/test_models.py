import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latticework.llm import chunks, lang_id, packing, quality, queries, sampling

from .conftest import words


def test_cheapest_cuts():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.choice((32, 512))
        p = [0]
        for _ in range(rng.randint(1, 30)):
            p.append(p[-1] + rng.randint(1, size))
        price = [0] + [rng.choice([0, 4, 9]) for _ in p[1:]]
        free = lambda n, size=size: n == size or (n >= 256 and n & (n - 1) == 0)
        best = [0] + [10**9] * (len(p) - 1)
        for j in range(1, len(p)):
            for i in range(j):
                n = p[j] - p[i]
                if n <= size:
                    best[j] = min(best[j], best[i] + (0 if free(n) else size - n) + price[j] + packing.WINDOW_COST)
        path = packing.cuts(np.array(p), np.array(price), size)
        cost = sum((0 if free(p[b] - p[a]) else size - p[b] + p[a]) + price[b] + packing.WINDOW_COST for a, b in zip(path, path[1:]))
        assert path[0] == 0 and path[-1] == len(p) - 1 and cost == best[-1]


def check_packing(rows, texts, size):
    plain = Tokenizer.from_file(packing.default_tokenizer())
    plain.encode_special_tokens = True
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= size


def test_packing_round_trip(docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 5000)
    rng = random.Random(2)
    texts = [". ".join(words(rng, rng.randint(1, 12)) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts += ["", None, "<|endoftext|> is text", "a" * 30_000, "no stops " * 3000, "日本語。 тест ½ ٣  \u0085 x​", "it's  \n\n  spaced   ", "퟿😀" * 50, "'ll 've\t\t x"]
    for size in (256, 2048):
        check_packing(packing.pack(docs(texts).withColumnRenamed("lang", "start"), packing.default_tokenizer(), size).collect(), texts, size)
    assert packing.pack(docs([]), packing.default_tokenizer()).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_chunks_cover_the_text(data):
    ends = chunks.boundaries(data)
    starts = [0, *ends][:-1]
    sizes = [e - s for s, e in zip(starts, ends, strict=True)]
    assert (ends[-1] if ends else 0) == len(data) and all(0 < n <= chunks.MOST for n in sizes) and all(n >= chunks.LEAST for n in sizes[:-1])
    assert chunks.from_text(chunks.to_text(chunks.fingerprint(data))) == chunks.fingerprint(data)


def test_chunks_resist_shifts():
    rng = random.Random(3)
    data = words(rng, 4000, 10**6).encode()
    a, b = chunks.fingerprint(data), chunks.fingerprint(b"some words before " + data)
    assert chunks.likeness(a, b) > 0.98 and chunks.likeness(a, chunks.fingerprint(words(rng, 4000, 10**6).encode())) < 0.02


def test_edited_likeness_matches_brute_force(docs):
    rng = random.Random(4)
    texts = [words(rng, rng.randint(0, 200), 10**6) + rng.choice(["", "é😀"]) for _ in range(50)] + ["", None, "abc", "x" * 50_000]
    ids = rng.sample(range(1000), len(texts))
    rows = {r.doc_id: r for r in chunks.edited_likeness(docs(texts, ids).withColumnRenamed("lang", "part")).collect()}
    order = sorted(zip(ids, texts, strict=True))
    assert len(rows) == len(texts)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        import hashlib

        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == chunks.to_text(chunks.fingerprint(t.encode())) and r.edited_fingerprint == chunks.to_text(chunks.fingerprint(edited.encode()))
        assert r.near_next == chunks.likeness(chunks.fingerprint(t.encode()), chunks.fingerprint(after.encode()))
    assert chunks.edited_likeness(docs([])).collect() == []
    single = chunks.edited_likeness(docs(["one text alone"], ids=[None])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    twice = chunks.edited_likeness(docs(["b", "a", "a"], ids=[1, 1, 1])).collect()
    assert len(twice) == 3


def test_language_accuracy_on_held_out_documents(spark):
    rows = queries.op10_language(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(both) == len(truth) and 0.15 < len(held) / len(both) < 0.25
    assert (held.lang == held.lang_pred).mean() > 0.97 and both.score.between(0, 1).all()


def test_samples_have_every_label(spark):
    rows = spark.createDataFrame([(2 * k + j, f"l{k}") for k in range(400) for j in range(2)], "doc_id long, lang string")
    chosen, sizes = sampling.per_label(rows, "lang", 10)
    assert len(sizes) == 400 and sorted(map(tuple, chosen.collect())) == sorted(map(tuple, rows.collect()))


def test_language_of_odd_rows(docs):
    assert lang_id.label_documents(docs([])).collect() == []
    texts = ["the cat and the dog", None, "", "123 ²", "x" * 50_000] * 4
    got = lang_id.label_documents(docs(texts).withColumnRenamed("source", "score"), sample_each=10).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)][:4] == ["en", "und", "und", "und"]
    unlabelled = lang_id.label_documents(docs(["some text"], lang=None)).collect()
    assert (unlabelled[0].lang_pred, unlabelled[0].score) == ("und", 0.0)
    assert [r.doc_id for r in lang_id.keep_identified(docs(["a b c"] * 20 + ["12 3"])).collect() if r.doc_id == 20] == []


def test_quality_on_held_out_documents(spark):
    rows = queries.op3_quality_crf(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality").toPandas()
    both = rows.merge(labels, on="doc_id")
    held = both[both.held_out]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert (held.predicted == held.quality).mean() > 0.98
    assert np.mean([(good > b).mean() for b in bad]) > 0.98
    assert (rows.predicted == (rows.score >= 0.3)).all()


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    texts = ["Good plain words here. And more of them.", "$$$ %% !! ## 11"] * 15 + ["", None, "\n" * 3000, "y" * 60_000]
    frame = docs(texts).withColumnRenamed("lang", "score").withColumnRenamed("source", "quality")
    got = quality.score_documents(frame, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    none = quality.score_documents(frame, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert quality.score_documents(docs([]), labels).collect() == []


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(5)
    weights = rng.normal(size=quality.PLACES)
    model = quality.Model(weights, 0.3, rng.normal(size=(2, 2)), 1.0, 0.0)
    at, _ = quality.places("One line.\nAnother | line\n\nLAST!!")
    s = weights[at].sum(axis=1)
    total = np.zeros((len(s), 2))
    for code in range(2 ** len(s)):
        y = [code >> k & 1 for k in range(len(s))]
        p = np.exp(sum(v * z for v, z in zip(s, y, strict=True)) + 0.3 * y[0] + sum(model.move[a, b] for a, b in zip(y, y[1:])))
        for k, z in enumerate(y):
            total[k, z] += p
    assert np.allclose(quality.marginals(model, at), total[:, 1] / total.sum(axis=1))


def test_field_gradient_learns_labels():
    data = [(quality.places("good words here.\nmore good words.")[0].astype(np.int64), 1), (quality.places("## $$ %%\n@@ ~~")[0].astype(np.int64), 0)] * 5
    model = quality.fit_field(data, 60)
    assert quality.marginals(model, data[0][0]).min() > 0.9 and quality.marginals(model, data[1][0]).max() < 0.1


def test_ids_of_the_query_are_those_of_the_plain_call(spark, docs, tmp_path):
    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    texts = ["<|endoftext|> is text", "a <|endoftext|><|endoftext|> b", "<|endoftext", "x <|ENDOFTEXT|>", "日本 <|endoftext|>", "", None, "plain words. " * 3000]
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op7_packing(spark, str(tmp_path)).collect()
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert sum(n for _, n, _ in own) == len(ids) and all(c == zlib.crc32(ids[a : a + n].tobytes()) for a, n, c in own)
    assert any(50256 in plain.encode(t, add_special_tokens=False).ids for t in texts[:2])


def test_settled_cuts_cost_no_more_than_cuts_at_once():
    rng = random.Random(8)

    def cost(p, price, path, size):
        free = lambda n: n == size or (n >= 256 and n & (n - 1) == 0)
        return sum((0 if free(p[b] - p[a]) else size - p[b] + p[a]) + price[b] + packing.WINDOW_COST for a, b in zip(path, path[1:]))

    for _ in range(40):
        size = rng.choice((64, 512))
        p = np.cumsum([0, *(rng.randint(1, size // rng.choice((1, 4, 16)) or 1) for _ in range(400))])
        price = np.array([0] + [rng.choice([0, 6, 256]) for _ in p[1:]])
        at, path, seen = 0, [0], 0
        for stop in range(10, len(p) + 1, 10):
            found = packing.settled_cuts(p[at:stop] - p[at], price[at:stop], size)
            path += [at + k for k in found[1:]]
            at, seen = path[-1], seen + len(found) - 1
        path += [at + k for k in packing.cuts(p[at:] - p[at], price[at:], size)[1:]]
        assert path[-1] == len(p) - 1 and seen > 0
        assert cost(p, price, path, size) == cost(p, price, packing.cuts(p, price, size), size)


def test_samples_are_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(k % 7, "x" * 100 + str(k)) for k in range(1000)] * 2, "doc_id long, at string")
    from pyspark.sql import functions as F

    assert len(sampling.bounded(rows, F.length("at"))) == 1000
    some = sampling.bounded(rows, F.length("at"), 20_000)
    assert 100 < len(some) < 300 and some == sampling.bounded(rows.repartition(5), F.length("at"), 20_000)


def test_regularised_leader_matches_a_dense_restatement():
    """Per coordinate, from the published update, on a toy of eight places and three classes."""
    import math

    rng = random.Random(4)
    rows = []
    for _ in range(40):
        at = np.array(sorted(rng.sample(range(8), 3)) + [lang_id.DIM])
        rows.append((at, np.array([rng.random() + 0.1 for _ in range(3)] + [1.0]), rng.randrange(3)))
    got = lang_id.ftrl(rows, 3, epochs=2)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= lang_id.L1:
            return 0.0
        return -(z[k] - math.copysign(lang_id.L1, z[k])) / ((lang_id.BETA + math.sqrt(n[k])) / lang_id.ALPHA + lang_id.L2)

    order = np.random.default_rng(3)
    for _ in range(2):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            w = {(i, c): weight((i, c)) for i in at.tolist() for c in range(3)}
            scores = [sum(w[i, c] * v for i, v in zip(at.tolist(), x, strict=True)) for c in range(3)]
            top = max(scores)
            total = sum(math.exp(s - top) for s in scores)
            for i, v in zip(at.tolist(), x, strict=True):
                for c in range(3):
                    g = (math.exp(scores[c] - top) / total - (c == y)) * v
                    sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / lang_id.ALPHA
                    z[i, c] += g - sigma * w[i, c]
                    n[i, c] += g * g
    for i in [*range(8), lang_id.DIM]:
        assert np.allclose(got[i], [weight((i, c)) for c in range(3)])


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(6)
    scores = rng.normal(size=(300, 3)) * 4
    truth = np.array([rng.choice(3, p=p) for p in lang_id._softmax(scores / 2.5)])
    smooth = 1 / (len(truth) + 2)

    def loss(t):
        p = np.log(lang_id._softmax(scores / t))
        return -((1 - smooth) * p[np.arange(300), truth] + smooth * p.mean(axis=1)).mean()

    best = min(np.exp(np.linspace(np.log(0.05), np.log(20), 4000)), key=loss)
    assert abs(np.log(lang_id.temperature(scores, truth) / best)) < 0.01


def test_vectors_are_tf_idf_of_all_grams():
    text = "Ab 1b!ab"
    at, n = lang_id.counts(text)
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    grams = [clean[k : k + m] for m in (1, 2, 3) for k in range(len(clean) - m + 1)]
    assert n.sum() == len(grams) and len(at) == len(set(grams)) and sorted(n) == sorted(grams.count(g) for g in set(grams))
    idf = np.arange(1, lang_id.DIM + 1) / lang_id.DIM
    x = lang_id.vector(at, n, idf)
    raw = np.array([(1 + np.log(k)) * idf[a] for a, k in zip(at, n, strict=True)])
    assert np.allclose(x, raw / np.sqrt((raw**2).sum()))


def test_field_fit_reaches_a_stationary_point():
    """The likelihood, enumerated over all labellings of small documents, has no slope left along any of several directions."""
    rng = np.random.default_rng(7)
    lines = ["good words here.", "More of the same, and more.", "## $$ %%", "@@ 11 22", "a", ""]
    texts = ["\n".join(rng.choice(lines, rng.integers(1, 5))) for _ in range(12)]
    data = [(quality.places(t)[0].astype(np.int64), int(k % 2)) for k, t in enumerate(texts)]
    model = quality.fit_field(data, 1500)

    def loss(weights, start, move):
        total, count = 0.0, 0
        for at, y in data:
            s = weights[at].sum(axis=1)
            logs = []
            for code in range(2 ** len(s)):
                label = [code >> k & 1 for k in range(len(s))]
                logs.append(sum(v * z for v, z in zip(s, label, strict=True)) + start * label[0] + sum(move[a, b] for a, b in zip(label, label[1:])))
            own = [y] * len(s)
            truth = sum(v * z for v, z in zip(s, own, strict=True)) + start * y + sum(move[a, b] for a, b in zip(own, own[1:]))
            total += np.logaddexp.reduce(logs) - truth
            count += len(s)
        squares = (weights**2).sum() + start**2 + (move**2).sum()
        return total / count + quality.PENALTY * squares / 2

    here = loss(model.weights, model.start, model.move)
    for _ in range(12):
        d = [rng.normal(size=quality.PLACES), rng.normal(), rng.normal(size=(2, 2))]
        e = 1e-4
        up = loss(model.weights + e * d[0], model.start + e * d[1], model.move + e * d[2])
        down = loss(model.weights - e * d[0], model.start - e * d[1], model.move - e * d[2])
        assert abs(up - down) / (2 * e) < 0.05 and up + down - 2 * here > 0


def byte_at_a_time(data):
    """Chunk ends by a gear hash that is rolled over one byte at a time."""
    ends, start, h = [], 0, 0
    for k, byte in enumerate(data):
        h = (h * 2 + int(chunks._GEAR[byte])) % (1 << 32)
        size = k + 1 - start
        zeros = 32 - h.bit_length()
        mark = size >= chunks.LEAST and (zeros >= chunks.RARE if size <= chunks.MEAN else zeros >= chunks.COMMON)
        if len(data) - start > chunks.LEAST and (mark or size >= chunks.MOST):
            ends.append(k + 1)
            start = k + 1
    return ends + ([len(data)] if start < len(data) else [])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_boundaries_match_a_rolling_hash(data):
    assert chunks.boundaries(data) == byte_at_a_time(data)
