"""Personal data: fixed forms first, then identifiers that their contexts give away.

Emails, IP addresses, card and phone numbers of the fixed forms are the seeds. The words
around every number- or address-like token are its lexical patterns (two words before; one
before; one before and one after). On the graph of patterns and instances, a pattern's
confidence for a kind is the share of its instances that belong to that kind, and an
instance's score combines its patterns' confidences; a few rounds of joins and sums spread
both from the seeds. Tokens of a kind's shape that trusted patterns, or the same
identifier's matches elsewhere, name with a high score become spans of that kind.

Numbers written with single blanks between their groups of digits are tokens as a whole,
besides the groups that are tokens by themselves; of overlapping discoveries the longest
stays. A run of groups with more than 19 digits is no such token.

DataFrame functions only. Texts are read once and never shuffled: what crosses a shuffle
are spans and their contexts. Patterns are possessive or guarded by what comes before, so
that long runs are scanned once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import ROW, checkpoint, row_key, unpacked, whole_row

KINDS = ("email", "ip", "card", "phone")
#: The fixed forms. A match that starts inside a run of its own characters could only
#: follow another match, so lookbehinds and possessive repeats change no match.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Tokens that may be identifiers.
TOKEN = r"(?<![A-Za-z0-9._%+@-])(?:[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++|\+?[0-9(][0-9().:/-]{4,}+)"
_GROUP = r"\(?[0-9]++(?:[().-]++[0-9]++)*+\)?+(?![:/]?[A-Za-z0-9_%@+])"
#: Groups of digits over single blanks that may be one identifier.
JOINED = rf"(?<![A-Za-z0-9._%+@-])\+?{_GROUP}(?:\x20{_GROUP})++"
#: Shape that a token must have to be taken for a kind.
SHAPES = {"email": r"^[^@]+@[^@]*[A-Za-z0-9]$", "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", "card": r"^(?:[\x20-]?[0-9]){12,19}$", "phone": r"^\+?(?:[\x20().-]*[0-9]){7,15}$"}
ROUNDS = 3
#: Least distinct seeds behind a pattern, and least confidence and score that are trusted.
SUPPORT, TRUST = 3, 0.8
_BLOCK = 256
#: Longer context words are named by their digest, so that a pattern's row stays small.
_LONG_WORD = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _before(steps: Column) -> Column:
    """For each element of a non-empty int array, the sum of those before it; sums by blocks keep it linear."""

    def of(d: Column) -> Column:
        last = F.floor((F.size(d) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: _sum(F.slice(d, b * _BLOCK + 1, _BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(blocks, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return _let(
            starts,
            lambda skip: F.transform(
                F.sequence(F.lit(0), F.size(d) - 1),
                lambda i: _let(F.floor(i / _BLOCK).cast("int"), lambda b: F.get(skip, b) + _sum(F.slice(d, b * _BLOCK + 1, i - b * _BLOCK))),
            ),
        )

    return _let(steps, of)


_SPAN = "struct<start: int, kind: int, end: int, match: string, left: string, right: string>"


def _last_words(gap: Column) -> Column:
    """The last two words of a text, or the only one; read from its end, so that a long text is passed over once."""
    return F.lower(F.reverse(F.regexp_extract(F.reverse(gap), r"^\s*+(\S++(?:\s++\S++)?)", 1)))


def _first_word(gap: Column) -> Column:
    return F.lower(F.regexp_extract(gap, r"^\s*+(\S++)", 1))


def matches(text: Column, form: str, kind: int, valid: Callable[[Column], Column] | None = None) -> Column:
    """Array of _SPAN for the leftmost non-overlapping matches of a form that are valid; positions in code points."""

    def spans(found: Column, pieces: Column) -> Column:
        steps = F.zip_with(found, F.slice(pieces, 2, F.size(found)), lambda m, p: F.length(m) + F.length(p))

        def one(at: Column, i: Column) -> Column:
            m, p, q = F.get(found, i), F.get(pieces, i), F.get(pieces, i + 1)
            start = F.length(F.get(pieces, F.lit(0))) + at
            return F.struct(
                start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), m.alias("match"),
                _last_words(p).alias("left"), _first_word(q).alias("right"),
            )

        made = F.transform(_before(steps), one)
        return F.filter(made, lambda s: valid(s["match"])) if valid else made

    none = F.array().cast(f"array<{_SPAN}>")
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    return _let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(_let(F.split(text, form, -1), lambda p: spans(m, p))))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


VALID: dict[str, Callable[[Column], Column] | None] = {
    "email": None,
    "ip": lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda m: _let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def base_spans(text: Column) -> Column:
    """Array of _SPAN of the fixed forms, by start and kind; kinds count from 0 as in KINDS."""
    none = F.array().cast(f"array<{_SPAN}>")
    needs = {"email": text.contains("@"), "phone": text.contains("+")}
    digit = text.rlike("[0-9]")
    parts = [F.when(needs.get(k, digit), matches(text, FORMS[k], n, VALID[k])).otherwise(none) for n, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def _patterns(span: Column) -> Column:
    """A span's lexical patterns: two words before it; one before; one before and one after."""

    def short(word: Column) -> Column:
        return F.when(F.length(word) > _LONG_WORD, F.concat(F.lit("#"), F.sha2(word.cast("binary"), 256))).otherwise(word)

    def of(words: Column) -> Column:
        one, two = short(F.element_at(words, -1)), F.when(F.size(words) > 1, short(F.get(words, F.lit(0))))
        after = F.when(span["right"] != "", short(span["right"]))
        return F.array_compact(F.array(F.concat(F.lit("2 "), two, F.lit(" "), one), F.concat(F.lit("1 "), one), F.concat(F.lit("3 "), one, F.lit(" _ "), after)))

    none = F.array().cast("array<string>")
    return F.when(span["left"] == "", none).otherwise(_let(F.split(span["left"], r"\s+"), of))


def score_instances(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(instance, kind, score) over edges(pattern, instance, counted) and seeds(instance, kind), both distinct.

    A pattern's confidence for a kind is the sum of its instances' scores, seeds having 1,
    over the number of its instances plus one half; below support seeds' worth or below
    trust it counts as nothing. An instance's score is one minus the product of what its
    patterns leave open. Edges that are not counted get scores but give patterns none. Every round is two equi-joins with sums on both sides; instances
    and patterns of any degree are summed before the shuffle.
    """
    known = seeds.select("instance", "kind", F.lit(1.0).alias("score"))
    counted = edges.where("counted")
    sizes = counted.groupBy("pattern").agg(F.count("*").alias("n"))
    scores = known
    for _ in range(rounds):
        weight = counted.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("weight")).where(F.col("weight") >= support)
        trusted = weight.join(sizes, "pattern").select("pattern", "kind", (F.col("weight") / (F.col("n") + 0.5)).alias("confidence")).where(F.col("confidence") >= trust)
        open_ = edges.join(trusted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
        scores = checkpoint(open_.join(known.select("instance", "kind"), ["instance", "kind"], "left_anti").unionByName(known))
    return scores


def _find(docs: DataFrame, rounds: int, support: int, trust: float) -> DataFrame:
    """(ROW..., base, spans) for each row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    tokens = F.when(text.rlike("[0-9@]"), matches(text, TOKEN, -1)).otherwise(none)
    joins = F.when(text.rlike(r"[0-9)]\x20[0-9(]"), matches(text, JOINED, -1, lambda m: F.length(_digits(m)).between(7, 19))).otherwise(none)
    marked = checkpoint(docs.select(*row_key(F.col("doc_id").cast("long"), text), base_spans(text).alias("base"), F.concat(tokens, joins).alias("tokens")))
    base = marked.select(F.explode("base").alias("s"))
    # a token ends before closing marks; those belong to the sentence
    bare = F.regexp_replace(F.col("s.match"), r"[().:/-]+$", "")
    loose = marked.select(*ROW, F.explode("tokens").alias("s")).select(*ROW, "s", bare.alias("instance"))
    # where a token starts, the groups joined to it are another reading of the same place
    counted = ~F.col("s.match").rlike(r"\x20") | ~F.col("s.match").rlike(r"^\+?[0-9(][0-9().:/-]{4}")
    named = base.select(F.col("s.match").alias("instance"), F.explode(_patterns(F.col("s"))).alias("pattern"), F.lit(True).alias("counted"))
    seen = named.unionByName(loose.select("instance", F.explode(_patterns(F.col("s"))).alias("pattern"), counted.alias("counted")))
    edges = checkpoint(seen.groupBy("pattern", "instance").agg(F.max("counted").alias("counted")))
    seeds = checkpoint(base.select(F.col("s.match").alias("instance"), F.col("s.kind").alias("kind")).distinct())
    shape = reduce(lambda c, k: F.when(F.col("kind") == k[0], F.col("instance").rlike(SHAPES[k[1]])).otherwise(c), enumerate(KINDS), F.lit(False))
    scored = score_instances(edges, seeds, rounds, support, trust).where((F.col("score") >= trust) & shape)
    best = scored.groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    start = F.col("s.start")
    span = F.struct(start.alias("start"), "kind", (start + F.length("instance")).alias("end"), F.col("instance").alias("match"))
    more = loose.join(best, "instance").groupBy(*ROW).agg(F.collect_set(span).alias("more"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["match"].alias("match")))
    joined = marked.select(*ROW, plain.alias("base")).join(more, list(ROW), "left")
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    # a token within joined groups starts before they end: the longest of those that overlap stays
    step = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start: int, kind: int, end: int, match: string>>").alias("out"))

    def longest(state: Column, m: Column) -> Column:
        apart = F.struct(m["end"].alias("end"), F.concat(state["out"], F.array(m)).alias("out"))
        last = F.element_at(state["out"], -1)
        longer = F.struct(m["end"].alias("end"), F.concat(F.slice(state["out"], 1, F.size(state["out"]) - 1), F.array(m)).alias("out"))
        return F.when(m["start"] >= state["end"], apart).when(m["end"] - m["start"] > last["end"] - last["start"], longer).otherwise(state)

    kept = F.aggregate(F.array_sort(free), step, longest, lambda s: s["out"])
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", kept)))
    return joined.select(*ROW, "base", spans.alias("spans"))


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(doc_id, base, spans) for each row of docs(doc_id, text): arrays of struct<start, kind, end, match>.

    base has the fixed forms, spans those and what contexts discover; a discovered span
    overlaps no base span. A null text counts as empty. Rows that repeat both doc_id and
    text give equal rows, rows that repeat only doc_id rows of their own, and so do rows
    without a doc_id. No rows, no result.
    """
    return _find(docs, rounds, support, trust).select(F.when(~F.col("unnamed"), F.col("id")).alias("doc_id"), "base", "spans")


def to_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    Each row is redacted by its own spans, whether its doc_id is repeated or null. A null
    text stays null, an empty one empty; all columns stay, whatever their names. No rows,
    no result.
    """
    found = _find(docs, rounds, support, trust).select(*ROW, "spans").dropDuplicates(list(ROW))
    names = F.array(*map(F.lit, KINDS))
    rows = docs.select(whole_row(docs), F.col("text").cast("string").alias("text"), *row_key(F.col("doc_id"), F.col("text")))

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        mark = F.concat(F.lit("<"), F.get(names, s["kind"]), F.lit(">"))
        kept = F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(gap, mark)).alias("out"))
        covered = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], kept).otherwise(covered)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cleaned = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(F.col("text"), s["at"] + 1, F.length("text"))))
    safe = F.when(F.size("spans") > 0, cleaned).otherwise(F.col("text"))
    return unpacked(rows.join(found, list(ROW), "left").select("row", safe.alias("safe")), docs.columns, text=F.col("safe"))
