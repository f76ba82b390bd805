"""Secret scans with a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: what every match must hold. Postings list, for each trigram that
the queries mention, the documents whose text holds it, case folded; they are intersected and united as the query
says, and only the documents that remain are searched with the pattern. A pattern without a mandatory trigram searches
all texts.

Documents are known by a key, a hash of id and text, so that null and repeated ids do no harm: equal rows share postings,
and a clash of two keys could only add a candidate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import support

#: More literal readings of a part of a pattern than this are given up: any text is taken to fit.
READINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` must read alike in Java and Python. A match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    inner: bool = False


#: The base kinds, then kinds that the index adds, in the order in which ties are listed.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]+)", 1, 20),
    # A run of these characters is gone through once, from its start to its first "eyJ"; where that gives no token, no later one does.
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?:(?!eyJ[A-Za-z0-9_-])[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+)", 1, 1, True),
)

# A query is True (any text), or a set of alternatives, each a set of trigrams of which all must be there.
Query = bool | frozenset


def _either(a: Query, b: Query) -> Query:
    return True if a is True or b is True else frozenset(x for x in a | b if not any(y < x for y in a | b))


def _both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    if len(a) * len(b) > READINGS:
        return min(a, b, key=len)
    return reduce(_either, (frozenset([x | y]) for x in a for y in b))


def _grams(texts: set[str]) -> Query:
    alternatives = [frozenset(text[i : i + 3] for i in range(len(text) - 2)) for text in texts]
    return True if not all(alternatives) else reduce(_either, (frozenset([x]) for x in alternatives))


def trigram_query(pattern: str) -> Query:
    """What every case-folded match of ``pattern`` must hold."""
    from re import _constants as code
    from re import _parser as parser

    def exact(op, value) -> set[str] | None:
        """All case-folded readings of one item if they are few."""
        if op is code.LITERAL:
            return {chr(value).lower()}
        if op is code.IN:
            found: set[str] = set()
            for kind, item in value:
                if kind is code.LITERAL:
                    found.add(chr(item).lower())
                elif kind is code.RANGE and item[1] - item[0] < READINGS:
                    found.update(chr(c).lower() for c in range(item[0], item[1] + 1))
                else:
                    return None
            return found if len(found) <= 8 else None
        return None

    def walk(items) -> Query:
        need: Query = True
        open_texts = {""}  # readings of the run of items just before, since the last unknown one

        def flush() -> None:
            nonlocal need, open_texts
            need, open_texts = _both(need, _grams(open_texts)), {""}

        def extend(texts: set[str]) -> None:
            nonlocal open_texts
            if len(open_texts) * len(texts) > READINGS:
                flush()
            open_texts = {a + b for a in open_texts for b in texts}

        for op, value in items:
            if (texts := exact(op, value)) is not None or (texts := readings([(op, value)])) is not None:
                extend(texts)
                continue
            flush()
            if op in (code.MAX_REPEAT, code.MIN_REPEAT) and value[0] > 0:
                need = _both(need, walk(value[2]))
            elif op is code.SUBPATTERN:
                need = _both(need, walk(value[3]))
            elif op is code.BRANCH:
                need = _both(need, reduce(_either, (walk(branch) for branch in value[1])))
        flush()
        return need

    def readings(items) -> set[str] | None:
        """All readings of a sequence of items, or None if one is unknown or they are too many."""
        texts = {""}
        for op, value in items:
            if op is code.SUBPATTERN:
                more = readings(value[3])
            elif op is code.BRANCH:
                parts = [readings(branch) for branch in value[1]]
                more = None if None in parts else set().union(*parts)
            elif op in (code.MAX_REPEAT, code.MIN_REPEAT) and value[1] == 1:
                once = readings(value[2])
                more = once and (once | {""} if value[0] == 0 else once)
            else:
                more = exact(op, value)
            if more is None or len(texts) * len(more) > READINGS:
                return None
            texts = {a + b for a in texts for b in more}
        return texts

    return walk(parser.parse(pattern))


def _keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carry)
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (``trigram``, ``key``) of the case-folded texts, for the given trigrams, in the shared folder."""
    folded = _keyed(docs).select("key", F.lower("text").alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(gram)), F.lit(gram)) for gram in trigrams]))
    return support.staged(folded.select("key", F.explode(held).alias("trigram")), "postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(``key``, ``kinds``) of the documents that may hold a match of a rule with a trigram query."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    held = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))
    alternative = lambda grams: reduce(Column.__and__, [F.array_contains("held", gram) for gram in sorted(grams)])
    kinds = [F.when(reduce(Column.__or__, [alternative(x) for x in sorted(query, key=sorted)]), F.lit(kind)) for kind, query in queries.items() if query is not True]
    return held.select("key", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def _sums_before(sizes: Column) -> Column:
    """For an array of lengths, the sums of all before each. Blocks are summed first, since appending copies an array."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes)))).cast("int")
    def inside(values: Column, start: Column) -> Column:
        begin = F.struct(start.alias("sum"), F.array().cast("array<long>").alias("out"))
        add = lambda done, n: F.struct((done["sum"] + n).alias("sum"), F.concat(done["out"], F.array(done["sum"])).alias("out"))
        return F.aggregate(values, begin, add, lambda done: done["out"])

    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), step), lambda i: i + 1)
    blocks = F.transform(starts, lambda i: F.slice(sizes, i, step))
    totals = inside(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0).cast("long"))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), totals.alias("t")), lambda z: inside(z["b"], z["t"])))


def _spans(asked: DataFrame) -> DataFrame:
    """Replace ``rules`` (those to be tried on a row's ``text``) by ``spans``: start, end in code points of the counted matches."""
    text = F.col("text")

    def matches(rule: Column) -> Column:
        whole, valued = (F.regexp_extract_all(text, rule["pattern"], group) for group in (F.lit(0), rule["group"]))
        return F.struct(rule["kind"].alias("kind"), rule["place"].alias("place"), rule["least"].alias("least"), rule["inner"].alias("inner"), whole.alias("whole"), valued.alias("valued"), F.split(text, rule["pattern"], -1).alias("gaps"))

    def sized(hit: Column) -> Column:
        zipped = F.arrays_zip(F.slice(hit["gaps"], 1, F.size(hit["whole"])).alias("gap"), hit["whole"].alias("whole"), hit["valued"].alias("valued"))
        lengths = F.transform(zipped, lambda z: F.struct(*[F.length(z[name]).cast("long").alias(name) for name in ("gap", "whole", "valued")]))
        return F.struct(hit["kind"].alias("kind"), hit["place"].alias("place"), hit["least"].alias("least"), hit["inner"].alias("inner"), lengths.alias("lengths"))

    def placed(hit: Column) -> Column:
        before = _sums_before(F.transform(hit["lengths"], lambda n: n["gap"] + n["whole"]))
        zipped = F.filter(F.arrays_zip(before.alias("before"), hit["lengths"].alias("n")), lambda z: z["n"]["valued"] >= hit["least"])
        end = lambda z: z["before"] + z["n"]["gap"] + z["n"]["whole"]
        start = lambda z: end(z) - F.when(hit["inner"], z["n"]["valued"]).otherwise(z["n"]["whole"])
        return F.transform(zipped, lambda z: F.struct(start(z).alias("start"), hit["place"].alias("place"), hit["kind"].alias("kind"), end(z).alias("end")))

    for step in (matches, sized, placed):
        asked = asked.withColumn("rules", F.transform("rules", step))
    spans = F.transform(F.array_sort(F.flatten("rules")), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return asked.withColumn("spans", spans).drop("rules")


def _quick(rule: Rule) -> str:
    """A pattern that finds a match wherever ``rule`` counts one, and gives up sooner where it does not."""
    return re.sub(r"\+$", f"{{{rule.least},}}", rule.pattern) if rule.group == 0 and rule.pattern.startswith("[") else rule.pattern


def scan(docs: DataFrame, rules: tuple[Rule, ...] = (*BASE, *ADDED), carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text`` and ``spans`` (``start``, ``kind``, ``end`` in code points, by start, then in the order of ``rules``) of every row.

    Matches are leftmost and do not overlap within a kind; spans of different kinds may. Null and empty texts have no spans. The columns
    ``carry`` of ``docs`` come along.
    """
    indexed = tuple(rule for rule in rules if trigram_query(rule.pattern) is not True)
    grams = sorted({gram for rule in indexed for grams in trigram_query(rule.pattern) for gram in grams})
    rows = _keyed(docs, carry)
    if indexed:
        found = support.staged(candidates(postings(docs, grams), indexed), "candidates")
        rows = support.with_lookup(rows, found, ["key"], "left")
    tried = []
    for place, rule in enumerate(rules):
        parts = {"kind": rule.kind, "place": place, "pattern": rule.pattern, "group": rule.group, "least": rule.least, "inner": rule.inner}
        asked = F.array_contains("kinds", rule.kind) if rule in indexed else F.col("text").rlike(_quick(rule))
        tried.append(F.when(asked, F.struct(*[F.lit(value).alias(name) for name, value in parts.items()])))
    return _spans(rows.select("doc_id", "text", *carry, F.array_compact(F.array(*tried)).alias("rules")))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, all spans as text."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(rule.kind)).cast("long").alias(f"n_{rule.kind}") for rule in BASE]
    base = F.sha2(line(of(*[rule.kind for rule in BASE])), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), line(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = (*BASE, *ADDED), mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of text under spans replaced by ``mark`` and ``n_chars`` counted anew; other columns as they are.

    Only texts with spans change; a null text stays null.
    """
    columns = docs.columns
    others = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row")
    rows = scan(docs.select("doc_id", "text", F.struct(others, F.isnull("text").alias("none")).alias("_held")), rules, ("_held",))
    text = F.when(~F.col("_held.none"), F.col("text"))
    # Overlapping spans are one stretch: a span that starts inside the one before lengthens it.
    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        new = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, new))

    stretches = F.aggregate("spans", F.array().cast("array<struct<start:long,end:long>>"), join)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("stretches", lambda s: s["end"]))
    ends = F.concat(F.transform("stretches", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    cuts = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda z: F.substring(text, (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int")))
    rows = rows.withColumn("stretches", stretches)
    rows = rows.withColumn("_clean", F.when(F.size("stretches") > 0, F.array_join(cuts, mark)).otherwise(text))
    old = lambda c: F.col(f"_held.row.`{c}`")
    changed = {"text": F.col("_clean"), "n_chars": F.when(F.size("stretches") > 0, F.length("_clean").cast("long")).otherwise(old("n_chars")) if "n_chars" in columns else None}
    return rows.select(*[(changed[c] if c in changed else old(c)).alias(c) for c in columns])
