import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from latticework.llm import cuckoo, line_dedup, spans

from .conftest import words

WS = " \t\n\r\x0b\x0c"


def key(line):
    return line.strip(WS).translate({c: c + 32 for c in range(65, 91)})


def brute(texts, ids):
    holders = defaultdict(set)
    for i, t in zip(ids, texts, strict=True):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return {i: "\n".join(x for x in (t or "").split("\n") if hot.get(key(x), i) == i) for i, t in zip(ids, texts, strict=True)}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    lines = [words(rng, rng.randint(1, 9), 30) for _ in range(25)] + ["ééééééééééééééééééé", "éééééééééééééééééééé", "  Shared LINE of many documents \t"]
    return ["\n".join(rng.choice(lines).upper() if rng.random() < 0.3 else rng.choice(lines) for _ in range(rng.randint(1, 12))) for _ in range(n)] + ["", None, "\n\n", "x" * 100_000]


def as_dict(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_line_dedup_matches_brute_force(docs):
    texts = corpus()
    done = line_dedup.dedup_lines(docs(texts).withColumnRenamed("source", "keys").withColumnRenamed("lang", "n_lines"))
    want = brute(texts, range(len(texts)))
    rows = done.collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_lines == len((texts[r.doc_id] or "").split("\n")) and r.n_dropped == r.n_lines - (len(want[r.doc_id].split("\n")) if want[r.doc_id] or r.n_dropped < r.n_lines else 0) for r in rows)
    assert "keys" in done.columns


def test_insertions_and_deletions_are_reversible(docs, monkeypatch):
    texts = corpus(2, 40)
    first, rest = docs(texts[:25]), docs(texts[25:], ids=range(25, len(texts)))
    index = line_dedup.build_index(first, shard_keys=4)
    grown = line_dedup.insert(index, rest)
    everything = docs(texts)
    assert as_dict(line_dedup.apply(grown, everything)) == brute(texts, range(len(texts)))
    back = line_dedup.delete(grown, rest.select("doc_id"))
    assert as_dict(line_dedup.apply(back, first)) == brute(texts[:25], range(25))
    for name in ("postings", "refs"):
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, getattr(index, name).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert as_dict(line_dedup.apply(back, first)) == brute(texts[:25], range(25))


def test_line_dedup_of_odd_rows(docs):
    assert line_dedup.dedup_lines(docs([])).collect() == []
    line = "a line of at least twenty characters"
    got = line_dedup.dedup_lines(docs([line] * 5, ids=[1, 2, 3, 3, None])).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, ""), (1, ""), (2, ""), (3, line), (3, line)]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys, others = rng.integers(0, 1 << 63, (5000, 2), np.uint64), rng.integers(0, 1 << 63, (20_000, 2), np.uint64)
    made = cuckoo.CuckooFilter(5000)
    assert made.insert(keys) and made.contains(keys).all()
    assert made.contains(others).mean() < 0.01
    made.delete(keys[:2500])
    again = cuckoo.CuckooFilter.from_bytes(made.to_bytes())
    assert again.contains(keys[2500:]).all() and again.contains(keys[:2500]).mean() < 0.01
    small = cuckoo.CuckooFilter(4)
    before = small.to_bytes()
    assert not small.insert(keys) and small.to_bytes() == before


def brute_spans(texts, ids):
    """Removed sentences by doc, from the definition."""
    import re

    seen, gone, pieces = set(), {}, {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        p = re.findall(r"[^.!?\n]+[.!?]*|[.!?\n]+", t or "")
        where = [k for k, x in enumerate(p) if x[0] not in ".!?\n" and x.translate(dict.fromkeys(map(ord, WS), " ")).split(" ") != [""] * (x.count(" ") + 1)]
        s = [" ".join(p[k].lower().split()) for k in where]
        gone[i], pieces[i] = set(), p
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                n = sum(len(x.split()) for x in s[a:b])
                if n >= 25 or (b - a >= 3 and n >= 8):
                    run = tuple(s[a:b])
                    if run in seen:
                        gone[i].update(where[a:b])
                    seen.add(run)
                    break
    return {i: "".join(x for k, x in enumerate(pieces[i]) if k not in gone[i]) for i in gone}


def test_spans_match_brute_force(docs):
    rng = random.Random(4)
    sentence = lambda: words(rng, rng.choice((1, 2, 5, 8, 30)), 50).capitalize() + rng.choice((". ", "! ", ".\n", "?\n", "... "))
    passages = ["".join(sentence() for _ in range(6)) for _ in range(4)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.3 else sentence() for _ in range(rng.randint(0, 12))) for _ in range(40)]
    texts += ["", "Same. Same. Same. Same words again here. " * 20, "no end", " \n ", "w " * 20_000]
    got = as_dict(spans.dedup_spans(docs(texts).withColumnRenamed("lang", "n_removed")))
    assert got == brute_spans(texts, range(len(texts)))


def brute_runs(texts):
    """Texts without any later copy of any run of the thresholds' size."""
    import re

    seen, out = set(), {}
    for i, t in enumerate(texts):
        p = re.findall(r"[^.!?\n]+[.!?]*|[.!?\n]+", t)
        where = [k for k, x in enumerate(p) if x[0] not in ".!?\n" and x.split()]
        s = [" ".join(p[k].lower().split()) for k in where]
        gone = set()
        for a in range(len(s)):
            n = 0
            for b in range(a + 1, len(s) + 1):
                n += len(s[b - 1].split())
                if n >= 25 or (b - a >= 3 and n >= 8):
                    run = tuple(s[a:b])
                    if run in seen:
                        gone.update(where[a:b])
                    seen.add(run)
        out[i] = "".join(x for k, x in enumerate(p) if k not in gone)
    return out


def test_whole_runs_match_brute_force_over_all_runs(docs):
    rng = random.Random(9)
    sentence = lambda: words(rng, rng.choice((1, 2, 5, 8, 12, 30)), 50).capitalize() + rng.choice((". ", "! ", ".\n", "... "))
    passages = ["".join(sentence() for _ in range(rng.randint(2, 6))) for _ in range(6)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(0, 12))) for _ in range(40)]
    texts += ["", "Same. Same. Same. Same words again here. " * 20, "no end", " \n "]
    got = as_dict(spans.dedup_spans(docs(texts), whole=True))
    assert got == brute_runs(texts)


def test_repeated_passage_goes_whole(docs):
    rng = random.Random(10)
    passage = "".join(words(rng, n, 10**6) + ". " for n in (30, 12, 10))
    texts = [passage + words(rng, 20, 10**6) + ".", words(rng, 20, 10**6) + ". " + passage, passage]
    got = as_dict(spans.dedup_spans(docs(texts), whole=True))
    assert got[0] == texts[0] and not got[2].strip() and got[1].strip(" ") == texts[1][: len(texts[1]) - len(passage)].strip(" ")


def test_spans_of_odd_rows(docs):
    assert spans.dedup_spans(docs([])).collect() == []
    text = words(__import__("random").Random(1), 40) + "."
    rows = spans.dedup_spans(docs([text, text, text, None], ids=[5, 5, None, 6])).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.n_removed) for r in rows) == [(-1, "", 1), (5, text, 0), (5, text, 0), (6, "", 0)]
    assert next(r for r in rows if r.doc_id == 6).text is None


@pytest.mark.parametrize("text", ["", "é" * 19, "é" * 20, " " * 50])
def test_line_key_counts_code_points(text):
    assert (line_dedup.line_key(text.encode()) is not None) == (len(text.strip(WS)) >= 20)


def test_query_digest(docs):
    from pyspark.sql import functions as F

    done = line_dedup.dedup_lines(docs(["a\nb"])).select(F.sha2(F.col("text").cast("binary"), 256).alias("h")).first()
    assert done.h == hashlib.sha256(b"a\nb").hexdigest()


def brute_passages(texts, enough):
    """Texts without any later copy of any long enough run of sentences."""
    import re

    seen, out = set(), {}
    for i, t in enumerate(texts):
        p = re.findall(r"[^.!?\n]+[.!?]*|[.!?\n]+", t)
        where = [k for k, x in enumerate(p) if x[0] not in ".!?\n" and x.split()]
        s = [" ".join(p[k].lower().split()) for k in where]
        gone = set()
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if enough(b - a, sum(len(x.split()) for x in s[a:b])):
                    run = tuple(s[a:b])
                    if run in seen:
                        gone.update(where[a:b])
                    seen.add(run)
        out[i] = "".join(x for k, x in enumerate(p) if k not in gone)
    return out


def test_passages_match_brute_force_over_all_runs(docs):
    rng = random.Random(19)
    sentence = lambda: words(rng, rng.choice((1, 2, 5, 8, 12, 30)), 50).capitalize() + rng.choice((". ", "! ", ".\n", "... "))
    passages = ["".join(sentence() for _ in range(rng.randint(1, 7))) for _ in range(8)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(0, 12))) for _ in range(40)]
    texts += ["", "Same. Same. Same. Same words again here. " * 20, "no end", " \n ", words(rng, 40, 5) + ".", words(rng, 40, 5) + "."]
    got = as_dict(spans.dedup_spans(docs(texts), whole=True, rule=spans.PASSAGES))
    assert got == brute_passages(texts, lambda n, w: n >= 2 and w >= 25)


def test_single_sentences_and_short_lines_stay(docs):
    rng = random.Random(20)
    alone = words(rng, 60, 10**6).capitalize() + "."
    line = "All rights reserved. No part of this may be copied. Ask first."
    texts = [f"{words(rng, 9, 10**6)}. {x}\n{words(rng, 9, 10**6)}." for x in (alone, alone, line, line)]
    assert as_dict(spans.dedup_spans(docs(texts), whole=True, rule=spans.PASSAGES)) == dict(enumerate(texts))


def test_spans_of_rows_without_an_id_and_clashing_names(docs):
    rng = random.Random(21)
    passage = ". ".join(words(rng, 15, 10**6) for _ in range(4)) + "."
    texts = [passage, passage, passage + " tail", passage]
    frame = docs(texts, ids=[None, None, None, 4]).withColumnRenamed("lang", "_span_doc").withColumnRenamed("source", "_done").withColumnRenamed("n_chars", "hashes")
    done = spans.dedup_spans(frame, whole=True, rule=spans.PASSAGES)
    assert done.columns == [*frame.columns, "n_sentences", "n_removed"]
    assert sorted((r.doc_id or -1, r.text, r._done) for r in done.collect()) == [(-1, "", "s"), (-1, "", "s"), (-1, " tail", "s"), (4, passage, "s")]
    unnamed = spans.dedup_spans(docs(texts[:3], ids=[None] * 3), whole=True, rule=spans.PASSAGES).collect()
    assert sorted(r.n_removed for r in unnamed) in ([0, 0, 4], [0, 4, 4])


def test_passages_match_sql(spark):
    import duckdb

    from latticework.llm import queries

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = db.execute(queries.oracle_sql()["op9_repeated_runs"]).fetchall()
    got = [tuple(r) for r in queries.op9_repeated_runs(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_dealt_filters_keep_the_same_postings(docs):
    texts = corpus(5, 80)
    index = line_dedup.build_index(docs(texts), shard_keys=3)
    want = {(r.doc_id, bytes(r.key)) for r in line_dedup._maybe(index).collect()}
    for part in (2, 10**6):
        got = [(r.doc_id, bytes(r.key)) for r in line_dedup._dealt(index, part).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) < index.postings.count()
    empty = line_dedup.build_index(docs([]))
    assert line_dedup._dealt(empty).collect() == [] and line_dedup._maybe(empty).collect() == []


def test_lines_of_rows_without_an_id_and_clashing_names(docs):
    line, other = "a line of at least twenty characters", "another line that is as long as the first"
    texts = [line + "\n1", line + "\n2", line + "\n2", other + "\nx", other + "\ny", other + "\nz", line + "\n3"]
    frame = docs(texts, ids=[None, None, None, None, None, None, 5]).withColumnRenamed("lang", "_drop_id").withColumnRenamed("source", "_done").withColumnRenamed("n_chars", "keys")
    done = line_dedup.dedup_lines(frame)
    assert done.columns == [*frame.columns, "n_lines", "n_dropped"]
    rows = [(r.doc_id, r.text) for r in done.collect()]
    assert (5, line + "\n3") in rows and sorted(t for i, t in rows if i is None and len(t) == 1) == ["1", "2", "2"] + sorted(t for i, t in rows if i is None and len(t) == 1)[3:]
    assert sum(other in t for _, t in rows) == 1  # the last of three documents without an id keeps it


def test_an_index_keeps_its_shard_size(docs):
    texts = corpus(6, 30)
    index = line_dedup.build_index(docs([]), shard_keys=2)
    grown = line_dedup.insert(index, docs(texts))
    assert grown.shard_keys == 2 and grown.filters.count() > 1
    assert as_dict(line_dedup.apply(grown, docs(texts))) == brute(texts, range(len(texts)))
