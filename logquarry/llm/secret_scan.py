"""Secrets found by rules over a trigram index.

Every rule is a regular expression. From its syntax tree follows a Boolean query over trigrams that any matching
text must satisfy: literals and small character sets are multiplied out, what can't be is cut at its borders. The
inverted index holds, per block of documents and trigram, the sorted keys of the documents that contain it. A rule's
query is evaluated on each block's postings by intersections and unions; only the documents that come out are verified
with the regular expression itself. A rule without mandatory trigrams (a run of any hexadecimal digits, say) scans all
texts. Index and queries fold A-Z to a-z, which can only add candidates.

Documents are keyed by a hash of id and text: equal rows share a posting, and a collision adds a candidate, never
loses one. Blocks are ranges of that hash, so neither a frequent trigram nor a repeated id gathers in one task.
With ``grams`` the index keeps only the trigrams that the rules at hand name; the default keeps all.

Matches are leftmost and do not overlap within a rule; those whose value is too short are dropped without a retry.
Positions count code points from 0, ends are exclusive. Null and empty texts have no spans, null and repeated ids no
special meaning, an empty table gives an empty index and result. Only the id and the text column are read; the result
has them and ``spans``.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.session import stage

MOST = 64  # strings that a part of a pattern may stand for before it is cut
BLOCK = 16_384  # documents whose postings form one block
STEPS = 256  # matches whose positions are summed at a time


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to look for, and how long the value (a group, or all of it) must be."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: Fixed rules: kind, pattern, least length, group.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a run of 24 or more starts where the run of any length does
]
EXTRA = [
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]{20,})", 20, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
]
RULES = [*BASE, *EXTRA]


# --- from a pattern to a query over trigrams ---------------------------------------------
# A query is True (anything may match), a trigram, or ("and" | "or", its parts).


def both(*queries):
    parts = frozenset(p for q in queries if q is not True for p in (q[1] if q[0] == "and" else [q]))
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def either(*queries):
    if True in queries:
        return True
    parts = {p for q in queries for p in (q[1] if q[0] == "or" else [q])}
    needs = {p: p[1] if p[0] == "and" else frozenset([p]) for p in parts}
    # an alternative that asks for all another one asks for adds nothing
    kept = frozenset(p for p in parts if not any(needs[o] < needs[p] for o in parts))
    return next(iter(kept)) if len(kept) == 1 else ("or", kept)


def of_strings(strings: set[str]):
    return either(*[both(*[s[i: i + 3] for i in range(len(s) - 2)]) for s in strings])


def characters(items) -> set[str] | None:
    """The folded characters of a class, or None where they are too many to multiply out."""
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < MOST:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST else None


def sequence(items) -> tuple[set[str] | None, object]:
    """``(strings, query)``: all folded strings the items can match, if few, and what any match must contain."""
    strings, asked, whole = {""}, [], True
    for item in items:
        found, query = node(*item)
        if found is not None and len(strings) * len(found) <= MOST:
            strings = {a + b for a in strings for b in found}
            continue
        whole = False
        asked += [of_strings(strings), query]
        tails = {s[-2:] for s in strings}
        strings = {""} if found is None else {a + b for a in tails for b in found} if len(tails) * len(found) <= MOST else found
    return (strings if whole else None), both(*asked, of_strings(strings))


def node(op, value) -> tuple[set[str] | None, object]:
    if op is sre.LITERAL:
        return {chr(value).lower()}, True
    if op is sre.IN:
        return characters(value), True
    if op is sre.AT:
        return {""}, True
    if op is sre.SUBPATTERN:
        return sequence(value[-1])
    if op is sre.BRANCH:
        found, queries = zip(*[sequence(v) for v in value[1]])
        joined = None if None in found else set().union(*found)
        return (joined if joined and len(joined) <= MOST else None), either(*queries)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        found, query = sequence(inner)
        if found is not None and (least, most) == (0, 1):
            return found | {""}, True
        if found is not None and least == most and len(found) ** least <= MOST:
            return {a for a in reduce(lambda s, _: {x + y for x in s for y in found}, range(least), {""})}, query
        return None, query if least else True
    return None, True  # any character, look-arounds, back references: nothing is known


def trigram_query(pattern: str):
    return sequence(parser.parse(pattern))[1]


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*[trigrams(p) for p in query[1]])


# --- the index ---------------------------------------------------------------------------


def document_key(id_column: str, text_column: str) -> Column:
    return F.xxhash64(id_column, text_column)


def folded_trigrams(low: Column, grams: list[str] | None) -> Column:
    if grams is not None:
        return F.filter(F.array(*[F.lit(g) for g in grams]).cast("array<string>"), lambda g: F.contains(low, g))
    letters = F.split(low, "")
    after = lambda k: F.slice(letters, k + 1, F.greatest(F.size(letters), F.lit(1)))
    runs = F.zip_with(F.zip_with(letters, after(1), lambda a, b: F.concat(a, b)), after(2), lambda ab, c: F.concat(ab, c))
    return F.array_distinct(F.filter(F.array_compact(runs), lambda g: F.length(g) == 3))


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", grams: list[str] | None = None) -> DataFrame:
    """``(block, gram, keys)``: sorted keys of at most about BLOCK documents. Write it where it is to be used again."""
    blocks = max(1, docs.count() // BLOCK)
    rows = docs.select(document_key(id_column, text_column).alias("key"), F.lower(text_column).alias("_low")).where("_low <> ''")
    each = rows.select("key", F.explode(folded_trigrams(F.col("_low"), grams)).alias("gram"))
    return each.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def answer(query, postings: Column) -> Column:
    """Keys of the documents of a block that satisfy the query."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(postings, F.lit(query)), F.array().cast("array<bigint>"))
    meet = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(meet, [answer(p, postings) for p in sorted(query[1], key=str)])


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(key, kinds)``: the documents whose trigrams satisfy the query of some rule that has one."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {kind: q for kind, q in queries.items() if q is not True}
    if not asked:
        return index.select(F.lit(0).cast("long").alias("key"), F.array().cast("array<string>").alias("kinds")).where("false")
    named = index.where(F.col("gram").isin(sorted(set().union(*map(trigrams, asked.values())))))
    block = named.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("_postings"))
    hits = block.select(F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), answer(q, F.col("_postings")).alias("keys")) for kind, q in asked.items()])).alias("h"))
    return hits.select("h.kind", F.explode("h.keys").alias("key")).groupBy("key").agg(F.collect_set("kind").alias("kinds"))


# --- verification ------------------------------------------------------------------------


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Spans of one rule as (start, place, end, kind), in order.

    The pieces between matches and the matches take turns, so sums of their lengths are the positions. They are summed
    in chunks: within a chunk from its first position, which is the sum of the chunks before.
    """
    none = no_spans()
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    widths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    values = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else widths
    steps = F.filter(F.zip_with(gaps, F.zip_with(widths, values, lambda w, v: F.struct(w.alias("w"), v.alias("v"))), lambda g, m: F.struct(
        g.alias("gap"), m["w"].alias("w"), m["v"].alias("v"))), lambda s: s["w"].isNotNull())

    def placed(steps: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STEPS).cast("int")), lambda i: F.slice(steps, i * STEPS + 1, F.lit(STEPS)))
        total = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s["gap"] + s["w"])
        firsts = F.aggregate(chunks, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + total(c))))
        grow = lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["w"]).alias("at"),
            F.when(s["v"] >= rule.least, F.concat(a["out"], F.array(F.struct(
                (a["at"] + s["gap"]).alias("start"), F.lit(place).alias("place"), (a["at"] + s["gap"] + s["w"]).alias("end"),
                F.lit(rule.kind).alias("kind"))))).otherwise(a["out"]).alias("out"))
        return F.flatten(F.zip_with(chunks, F.slice(firsts, F.lit(1), F.size(chunks)), lambda c, at: F.aggregate(
            c, F.struct(at.alias("at"), none.alias("out")), grow, lambda a: a["out"])))

    # one evaluation of the steps serves all uses: they are bound as the only element of an array
    found = F.flatten(F.transform(F.array(steps), placed))
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def find(docs: DataFrame, rules: list[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text",
         index: DataFrame | None = None) -> DataFrame:
    """``docs``' id and text columns with ``spans``, an array of (start, place, end, kind) by start, then by place of the rule.

    Without an ``index`` one is built over the trigrams that the rules name.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted(set().union(*map(trigrams, queries.values())))
    if index is None:
        index = stage(build_index(docs, id_column, text_column, grams))
    asked = stage(candidates(index, rules))
    rows = docs.select(id_column, text_column).withColumn("_key", document_key(id_column, text_column))
    joined = rows.join(asked.withColumnRenamed("key", "_key").withColumnRenamed("kinds", "_kinds"), "_key", "left")
    text = F.coalesce(F.col(text_column), F.lit(""))
    each = []
    for place, rule in enumerate(rules):
        found = spans_of(text, rule, place)
        named = F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False))
        each.append(found if queries[rule.kind] is True else F.when(named, found).otherwise(no_spans()))
    return joined.select(id_column, text_column, F.array_sort(F.concat(*each)).alias("spans"))


def digest(spans: Column, kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` of each span, comma-joined; of all kinds or the given ones."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
