"""Secret scans with a trigram index (native: DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small


@dataclass(frozen=True)
class Rule:
    """kind, a regular expression that Java, Python and RE2 read alike, and the length that `group` must have in a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# What the scan must find.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Published shapes of other credentials.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: Alternatives that are followed side by side; beyond it a part of a pattern says nothing.
SPREAD = 24


def trigram_query(pattern: str):
    """The Boolean query that every text with a match satisfies: True (no mandatory trigram), a trigram of the lower-cased
    text, or ("and" | "or", parts). Literal stretches give their trigrams, alternatives an "or", and whatever is
    optional, repeated or a wide class ends a stretch without a claim."""

    def all_of(parts):
        parts = sorted({p for p in parts if p is not True}, key=str)
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))

    def any_of(parts):
        parts = list(parts)
        if True in parts or not parts:
            return True
        parts = set(parts)
        needs = {p: frozenset(p[1]) if not isinstance(p, str) and p[0] == "and" else frozenset([p]) for p in parts}
        parts = sorted((p for p in parts if not any(needs[q] < needs[p] for q in parts)), key=str)  # what asks more than another adds nothing
        return parts[0] if len(parts) == 1 else ("or", tuple(parts))

    def of_strings(strings):
        return any_of(all_of(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)

    def chars(item):
        op, arg = item
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN and arg[0][0] is not sre.NEGATE:
            out = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    out.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < SPREAD:
                    out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return out
        return None

    def walk(items):
        """(strings that are the whole match, or None; query)"""
        done, exact, whole = [], {""}, True
        for op, arg in items:
            got = chars((op, arg))
            claim = True
            if got is None and op is sre.SUBPATTERN:
                got, claim = walk(arg[-1])
            elif got is None and op is sre.BRANCH:
                ways = [walk(x) for x in arg[1]]
                got = set().union(*(w[0] for w in ways)) if all(w[0] is not None for w in ways) else None
                claim = any_of(w[1] for w in ways)
            elif got is None and op is sre.MAX_REPEAT:
                low, high, inner = arg
                strings, claim = walk(inner)
                if strings is not None and (low, high) == (0, 1):
                    got, claim = strings | {""}, True
                elif strings is not None and low == high == 1:
                    got = strings
                elif low == 0:
                    claim = True
            if got is not None and len(got) * len(exact) <= SPREAD:
                exact = {a + b for a in exact for b in got}
            else:
                done += [of_strings(exact), claim]
                exact, whole = {""}, False
        return (exact if whole else None), all_of([*done, of_strings(exact)])

    return walk(sre_parse.parse(pattern))[1]


def vocabulary(queries) -> list[str]:
    """All trigrams that the queries name, in order."""
    out: set[str] = set()

    def collect(q):
        if isinstance(q, str):
            out.add(q)
        elif q is not True:
            for x in q[1]:
                collect(x)

    for q in queries:
        collect(q)
    return sorted(out)


def clauses(query) -> list[tuple[str, ...]]:
    """The query as alternatives, each a set of trigrams that must all occur; what asks more than another is left out."""
    if isinstance(query, str):
        return [(query,)]
    parts = [[frozenset(c) for c in clauses(q)] for q in query[1]]
    ways = {frozenset().union(*each) for each in product(*parts)} if query[0] == "and" else {c for p in parts for c in p}
    return sorted(tuple(sorted(w)) for w in ways if not any(v < w for v in ways))


def key_of(body: Column) -> Column:
    """What a text is called in the index: its digest, so copies are one posting and repeated ids don't matter."""
    return F.unhex(F.md5(body))


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The inverted index, written once: a row (gram, key) for each text and each trigram in it that any rule's query names, by the trigram's
    place in the vocabulary. It serves any scan of these texts by these rules or some of them."""
    grams = vocabulary(trigram_query(r.pattern) for r in rules)
    body = F.coalesce(F.col(text), F.lit(""))
    low = docs.select(key_of(body).alias("key"), F.lower(body).alias("low"))
    here = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]), lambda g: g.isNotNull())
    return saved(low.select(F.explode(here).alias("gram"), "key"), "postings")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, rules (bit k: rules[k] may match): the postings of each alternative's trigrams, intersected, and united by rule.

    A posting counts as one bit of each alternative that names its trigram; bits are gathered by (rule, alternative, key), combined before
    the shuffle, and an alternative holds where all of its bits are there."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = vocabulary(queries)
    ways = [(k, c) for k, q in enumerate(queries) if q is not True for c in clauses(q)]
    of = [[(w, c.index(g)) for w, (_, c) in enumerate(ways) if g in c] for g in grams]
    lists = F.array(*[F.array(*[F.struct(F.lit(w).alias("way"), F.lit(1 << at).cast("long").alias("bit")) for w, at in each]) for each in of])
    met = postings.select("key", F.inline(F.element_at(lists, F.col("gram") + 1))).groupBy("way", "key").agg(F.bit_or("bit").alias("bits"))
    all_bits = F.array(*[F.lit((1 << len(c)) - 1).cast("long") for _, c in ways])
    of_rule = F.array(*[F.lit(1 << k).cast("long") for k, _ in ways])
    return met.filter(F.col("bits") == F.element_at(all_bits, F.col("way") + 1)).groupBy("key").agg(F.bit_or(F.element_at(of_rule, F.col("way") + 1)).alias("rules"))


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def running(values: Column, over, nothing: int) -> Column:
    """For each place of an array what `over` gives for the values up to it. In blocks of 32, as an array that grows by one value at a time is copied each time."""

    def fold(part):
        return F.aggregate(part, F.lit(nothing), over)

    def blocks(v):
        sums = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / 32).cast("int") - 1), lambda b: fold(F.slice(v, b * 32 + 1, F.lit(32))))
        grown = F.aggregate(sums, F.array(F.lit(nothing)), lambda acc, x: F.concat(acc, F.array(over(F.element_at(acc, -1), x))))
        return bound(grown, lambda before: F.transform(v, lambda _, i: over(F.get(before, F.floor(i / 32).cast("int")), fold(F.slice(v, F.floor(i / 32).cast("int") * 32 + 1, i % 32 + 1)))))

    return bound(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(v))


def found(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of the rule's leftmost matches that do not overlap, in code points.

    A text is its matches and what lies between them in turn, so the running length of both gives the places."""
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    check = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else hits

    def placed(h):
        each = F.zip_with(h["n"], h["g"], lambda n, g: F.struct(n.alias("n"), g.alias("g")))
        ends = running(F.zip_with(F.slice(h["gaps"], 1, F.size(h["n"])), h["n"], lambda gap, n: gap + n), lambda a, b: a + b, 0)
        spans = F.zip_with(each, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), F.lit(order).alias("kind"), end.alias("end"), x["g"].alias("g")))
        return F.transform(F.filter(spans, lambda s: s["g"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return bound(F.struct(between.alias("gaps"), hits.alias("n"), check.alias("g")), placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", postings: DataFrame | None = None) -> DataFrame:
    """docs with column __spans: array of (start, kind, end) in code points, end exclusive, by start and then rule.

    Each rule's Boolean trigram query is answered on the index (built here unless it is given), and its expression runs on the
    candidates alone. A rule without mandatory trigrams (a class repeated) runs on every text. Candidates' keys go to the texts while they
    fit a checked broadcast, so texts don't move; beyond that both sides shuffle by key. Null or empty text: no spans. Repeated rows: each has
    its own. Long texts, ties and skew don't matter: postings of one key combine before they move, and a row's work follows its length.
    Empty table: no rows. Extra columns stay; those named __key, __rules and __spans are replaced.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop("__key", "__rules", "__spans")
    if any(q is not True for q in queries):
        some = saved(candidates(index(rows, rules, text) if postings is None else postings, rules), "candidates").withColumnsRenamed({"key": "__of", "rules": "__rules"})
        rows = rows.withColumn("__key", key_of(body)).join(small(some), F.col("__key") == F.col("__of"), "left").drop("__key", "__of")
    else:
        rows = rows.withColumn("__rules", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for k, (rule, query) in enumerate(zip(rules, queries)):
        sure = F.col("__rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0 if query is not True else body.rlike(rule.pattern)
        parts.append(F.when(sure, found(body, rule, k)).otherwise(none))
    return rows.withColumn("__spans", F.array_sort(F.concat(*parts))).drop("__rules")


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


#: Code points of the pieces that a text is cut into, so that a cut far behind doesn't count from the front.
PIECE = 512


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[secret]", postings: DataFrame | None = None) -> DataFrame:
    """docs with every span in `text` replaced by the mark; spans that touch or overlap become one. Null stays null.

    The pieces between the marks are cut and joined once, so the work follows the text's length and its number of spans."""
    scanned = scan(docs, rules, text, postings)
    body = F.col(text)
    upto = running(F.transform("__spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b), -1)

    def cut(x, at, to):
        first = F.floor(at / PIECE).cast("int")
        return F.substring(F.array_join(F.slice(x["pieces"], first + 1, F.floor(to / PIECE).cast("int") - first + 1), ""), at % PIECE + 1, to - at)

    def kept(x):
        ends = F.concat(F.array(F.lit(-1)), x["upto"])
        spans = F.zip_with(F.transform("__spans", lambda s: s["start"]), F.slice(ends, 1, F.size("__spans")), lambda start, before: F.struct(start.alias("start"), before.alias("before")))
        heads = F.filter(spans, lambda s: s["start"] > s["before"])
        parts = F.transform(heads, lambda s: F.concat(cut(x, F.greatest(s["before"], F.lit(0)), s["start"]), F.lit(mark)))
        return F.concat(F.array_join(parts, ""), cut(x, F.element_at(x["upto"], -1), F.length(body)))

    clean = bound(F.struct(upto.alias("upto"), F.regexp_extract_all(body, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces")), kept)
    return scanned.withColumn(text, F.when(F.size("__spans") > 0, clean).otherwise(body)).drop("__spans")
