"""Secret scans through a trigram index, in DataFrame functions only.

Each rule is a regular expression. From its parsed form comes a Boolean query:
alternatives, each a set of trigrams that any match must hold (in lower case).
The index holds, for every trigram that some rule asks for, which documents
have it: a posting list a trigram, kept as a bit of a long a document, so that
intersecting lists is a bitwise AND in place and no text moves. Documents that
satisfy a rule's query are its candidates; only for them is the expression run.
Rules without a mandatory trigram (hex) run over every text.

Matches are leftmost and don't overlap within a rule. Spans are code points,
end exclusive: their starts are the lengths of what splitting at the matches
leaves, summed up with those of the matches before.

Defined results: null is an empty text without spans; a null id is passed on;
extra columns are ignored; repeated rows repeat; equal starts go in the order
in which the rules are listed.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as text_functions
from loomgraph.llm import common

#: Alternatives that a Boolean query may have before it gives up on more.
MOST_ALTERNATIVES = 32


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group that least counts, and how many characters it must have; shorter matches are dropped.
    group: int = 0
    least: int = 0


#: Fixed values. The first three rules are the base.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3

# ---------------------------------------------------------------- Boolean queries


def _words(node) -> set[str] | None:
    """The strings that a parsed part can match, in lower case, if they are few."""
    kind, value = node
    if kind is sre.LITERAL:
        return {chr(value).lower()}
    if kind is sre.IN:
        out = set()
        for sort, x in value:
            if sort is not sre.LITERAL:
                return None
            out.add(chr(x).lower())
        return out if len(out) <= 6 else None
    if kind is sre.SUBPATTERN:
        return _sequence_words(value[3])
    if kind is sre.BRANCH:
        parts = [_sequence_words(x) for x in value[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = value
        own = _sequence_words(inner)
        if own is None or high is sre.MAXREPEAT or high > 3:
            return None
        out, step = set(), {""}
        for n in range(int(high) + 1):
            if n >= low:
                out |= step
            step = {a + b for a in step for b in own}
        return out
    return {""} if kind is sre.AT else None


def _sequence_words(parts) -> set[str] | None:
    out = {""}
    for node in parts:
        own = _words(node)
        if own is None:
            return None
        out = {a + b for a in out for b in own}
        if len(out) > MOST_ALTERNATIVES:
            return None
    return out


def _grams(word: str) -> frozenset[str]:
    return frozenset(word[i : i + 3] for i in range(len(word) - 2))


def _least(query: set[frozenset[str]]) -> set[frozenset[str]]:
    return {a for a in query if not any(b < a for b in query)}


def boolean_query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams that must all occur; one empty alternative if nothing is mandatory."""

    def both(a: set, b: set) -> set:
        made = _least({x | y for x in a for y in b})
        return made if len(made) <= MOST_ALTERNATIVES else a

    def sequence(parts) -> set[frozenset[str]]:
        query, run = {frozenset()}, {""}
        for node in parts:
            own = _words(node)
            joined = {a + b for a in run for b in own} if own is not None else None
            if joined is not None and len(joined) <= MOST_ALTERNATIVES:
                run = joined
                continue
            query = both(query, _least({_grams(w) for w in run}))
            run = own if own is not None else {""}
            if own is None:
                query = both(query, part(node))
        return both(query, _least({_grams(w) for w in run}))

    def part(node) -> set[frozenset[str]]:
        kind, value = node
        if kind is sre.SUBPATTERN:
            return sequence(value[3])
        if kind is sre.BRANCH:
            return _least(set().union(*(sequence(x) for x in value[1])))
        if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            return sequence(value[2])
        return {frozenset()}

    return sorted(sorted(x) for x in sequence(parser.parse(pattern)))


# ---------------------------------------------------------------- index


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that some rule asks for: the index's terms."""
    return sorted({g for r in rules for x in boolean_query(r.pattern) for g in x})


def indexed(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", bits: str = "bits") -> DataFrame:
    """The documents with bits array<long>: bit i % 63 of number i / 63 is set where term i of the vocabulary occurs."""
    terms = vocabulary(rules)
    (name,) = common.free_names(documents, "lower")
    lower = documents.withColumn(name, F.lower(F.coalesce(F.col(text), F.lit(""))))
    longs = []
    for low in range(0, max(len(terms), 1), 63):
        own = F.lit(0).cast("long")
        for i, term in enumerate(terms[low : low + 63]):
            own = own.bitwiseOR(F.when(F.contains(name, F.lit(term)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        longs.append(own)
    return lower.withColumn(bits, F.array(*longs)).drop(name)


def postings(index: DataFrame, key: str = "doc_id", rules: tuple[Rule, ...] = RULES, bits: str = "bits") -> DataFrame:
    """(gram, key): the index as lists, a row an entry."""
    terms = vocabulary(rules)
    present = [F.when(F.col(bits)[i // 63].bitwiseAND(F.lit(1 << (i % 63)).cast("long")) != 0, F.lit(t)) for i, t in enumerate(terms)]
    return index.select(key, F.explode(F.array_compact(F.array(*present))).alias("gram")).select("gram", key)


def listed_candidates(lists: DataFrame, key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, key) by intersecting posting lists: documents that stand in all lists of an alternative. The same as `candidate` says of each document, at the price of a shuffle."""
    asked = [(n, a, g, len(x)) for n, rule in enumerate(rules) for a, x in enumerate(boolean_query(rule.pattern)) for g in x]
    wanted = lists.sparkSession.createDataFrame(asked, "rule int, alternative int, gram string, need int")
    met = lists.join(F.broadcast(wanted), "gram")  # a row a trigram of an alternative
    return met.groupBy("rule", "alternative", key).agg(F.count_distinct("gram").alias("have"), F.first("need").alias("need")).where("have = need").select("rule", key).distinct()


def candidate(rule: Rule, rules: tuple[Rule, ...] = RULES, bits: str = "bits") -> Column:
    """Whether a document of the index satisfies a rule's Boolean query: lists intersected, alternatives united."""
    terms = vocabulary(rules)
    found = F.lit(False)
    for alternative in boolean_query(rule.pattern):
        every = F.lit(True)
        for number in sorted({terms.index(g) // 63 for g in alternative}):
            mask = sum(1 << (terms.index(g) % 63) for g in alternative if terms.index(g) // 63 == number)
            every = every & (F.col(bits)[number].bitwiseAND(F.lit(mask).cast("long")) == mask)
        found = found | every
    return found


# ---------------------------------------------------------------- verification

_SPANS = "array<struct<start:int,rule:int,end:int>>"


def _matches(rule: Rule, number: int, text: str) -> Column:
    """Spans of a rule's matches in a column."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)

    def spans_of(paired: Column) -> Column:
        made = F.zip_with(paired, text_functions.running(F.transform(paired, lambda x: x["gap"] + F.length(x["m"])), lambda a, b: a + b), lambda x, end: F.struct(x["m"].alias("m"), F.struct((end - F.length(x["m"])).alias("start"), F.lit(number).alias("rule"), end.alias("end")).alias("span")))
        if rule.least:
            made = F.filter(made, lambda x: F.length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least)
        return F.transform(made, lambda x: x["span"])

    paired = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    return text_functions.let(paired, spans_of).cast(_SPANS)


def spans(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "spans") -> DataFrame:
    """keep, then out array<struct<start, rule, end>> of all rules by start and rule; rule is the place in the list."""
    whole, bits = common.free_names(documents, "whole", "bits")
    index = indexed(documents.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(whole)), rules, whole, bits)
    parts = []
    for number, rule in enumerate(rules):
        # of a text without a match only the index, or one search, is looked at
        worth = candidate(rule, rules, bits) & F.col(whole).rlike(rule.pattern)
        parts.append(F.when(worth, _matches(rule, number, whole)).otherwise(F.array().cast(_SPANS)))
    return index.select(*keep, F.array_sort(F.concat(*parts)).alias(out))


def label(column: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["rule"] + 1), x["start"], x["end"])), ",")


def masked(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every span, overlapping ones as one, replaced by the mask; other columns as they are, whatever their names, nulls null."""
    (found,) = common.free_names(documents, "found")
    marked = spans(documents, rules, text, tuple(documents.columns), found)
    covered = F.col(found)
    # what ends before a span begins: the furthest end so far, so that a span within another leaves no gap
    furthest = text_functions.running(F.transform(covered, lambda x: x["end"]), F.greatest)
    before = F.slice(F.concat(F.array(F.lit(0)), furthest), 1, F.size(covered))
    apart = F.filter(F.zip_with(covered, before, lambda x, at: F.struct(x["start"].alias("start"), at.alias("at"))), lambda x: x["start"] >= x["at"])
    pieces = F.transform(apart, lambda x: F.substring(F.col(text), x["at"] + 1, x["start"] - x["at"]))
    tail = F.substring(F.col(text), F.array_max(furthest) + 1, F.length(text))
    return marked.withColumn(text, F.when(F.size(covered) == 0, F.col(text)).otherwise(F.array_join(F.concat(pieces, F.array(tail)), mask))).select(*documents.columns)


def oracle(rules: tuple[Rule, ...] = RULES, base: int = BASE) -> str:
    """DuckDB SQL for the query: every rule's matches and the lengths around them."""
    parts = []
    for number, rule in enumerate(rules):
        p = rule.pattern.replace("'", "''")
        least = f"where length(regexp_extract(m[i], '{p}', {rule.group})) >= {rule.least}" if rule.least else ""
        parts.append(f"""select doc_id, text, {number} as rule, '{rule.kind}' as kind, s as lo, s + length(m[i]) as hi from (
          select *, coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s from (
            select *, unnest(range(1, len(m) + 1)) as i from (select doc_id, text, regexp_extract_all(text, '{p}', 0) as m, string_split_regex(text, '{p}') as gap from t))) {least}""")
    joined = " union all ".join(parts)
    name = "kind || ':' || cast(lo as bigint) || ':' || cast(hi as bigint)"
    return f"""with t as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
    found as ({joined})
    select t.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      sha256(coalesce(string_agg({name}, ',' order by lo, rule) filter (rule < {base}), '')) as base_sha256,
      coalesce(string_agg({name}, ',' order by lo, rule) filter (rule is not null), '') as spans
    from t left join found on t.doc_id = found.doc_id and t.text = found.text group by t.n, t.doc_id"""
