"""Secret scans through a trigram index, in DataFrame functions alone.

Each rule's pattern yields a Boolean query on trigrams: a conjunction of steps, each step a choice between sets of
trigrams of which one set must be in a text.  The index holds (trigram, doc_id) postings for the trigrams that the
rules ask for.  Postings are intersected per document, and only rules whose query holds are matched on its text.
Rules without mandatory trigrams are matched on all texts.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import fresh, stored, texts_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and non-overlapping, whose `group` has `least` characters or more.

    Patterns keep to what Java, Python and RE2 read alike.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed patterns: these three are the base; their order orders spans that start at one place.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Fixed patterns of published token formats.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{1,64}@"),
)
RULES = BASE + MORE

Query = list[list[frozenset[str]]]
MOST_STRINGS = 48


def trigram_query(pattern: str) -> Query:
    """Steps that all must hold for a text, lower-cased, to match; each is a choice of trigram sets.  []: no demand."""
    steps: Query = []

    def flush(strings: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in sets:
            sets = {s for s in sets if not any(o < s for o in sets)}
            if sets and sorted(map(sorted, sets)) not in [sorted(map(sorted, x)) for x in steps]:
                steps.append(sorted(sets, key=sorted))

    def one(op, arg) -> set[str] | None:
        """The strings that a part of a pattern matches, lower-cased; None if there are too many."""
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            out: set[str] = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    out.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 4:
                    out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return out if len(out) <= 6 else None
        if op is sre.SUBPATTERN:
            return whole(arg[3])
        if op is sre.BRANCH:
            out = set()
            for branch in arg[1]:
                part = whole(branch)
                if part is None:
                    return None
                out |= part
            return out
        if op is sre.MAX_REPEAT:
            low, high, inner = arg
            part = whole(inner)
            if part is None or high > 3:
                return None
            out = {""} if low == 0 else set()
            power = {""}
            for n in range(1, high + 1):
                power = {a + b for a in power for b in part}
                out |= power if n >= low else set()
            return out
        return None

    def whole(tree) -> set[str] | None:
        acc = {""}
        for op, arg in tree:
            part = one(op, arg)
            if part is None or len(acc) * len(part) > MOST_STRINGS:
                return None
            acc = {a + b for a in acc for b in part}
        return acc

    def walk(tree) -> None:
        acc = {""}
        for op, arg in tree:
            part = one(op, arg)
            if part is not None and len(acc) * len(part) <= MOST_STRINGS:
                acc = {a + b for a in acc for b in part}
                continue
            flush(acc)
            acc = part if part is not None and len(part) <= MOST_STRINGS else {""}
            if part is None and op is sre.SUBPATTERN:
                walk(arg[3])
            elif part is None and op is sre.MAX_REPEAT and arg[0] > 0:
                walk(arg[2])
        flush(acc)

    walk(sre_parser.parse(pattern, re.ASCII))
    return steps


def trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for step in trigram_query(r.pattern) for choice in step for t in choice})


def postings(docs: DataFrame, words: list[str]) -> DataFrame:
    """The inverted index: one row (trigram, doc_id) for each of the trigrams `words` in a lower-cased text."""
    low = texts_of(docs).select("doc_id", F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, words)), lambda t: F.contains(F.col("low"), t))
    return low.select(F.explode(held).alias("trigram"), "doc_id")


def _holds(query: Query, have: Column) -> Column:
    out = F.lit(True)
    for step in query:
        any_of = F.lit(False)
        for choice in step:
            any_of = any_of | (F.size(F.array_intersect(have, F.array(*map(F.lit, sorted(choice))))) == len(choice))
        out = out & any_of
    return out


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and the kinds whose trigram query its postings meet; documents without any are left out."""
    per_doc = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))  # at most the rules' few trigrams
    asked = [(r.kind, q) for r in rules if (q := trigram_query(r.pattern))]
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("have")), F.lit(kind)) for kind, q in asked]))
    return per_doc.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


SPAN = "array<struct<start:int,order:int,kind:string,stop:int>>"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule in a text, in code points: what lies between matches gives where they are."""
    between = F.split(text, rule.pattern, -1)
    match = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else match
    lengths = F.transform(F.arrays_zip(match.alias("m"), group.alias("g")), lambda x: F.struct(F.length(x["m"]).alias("m"), F.length(x["g"]).alias("g")))
    zipped = F.zip_with(F.slice(between, 1, F.size(match)), lengths, lambda b, x: F.struct(F.length(b).alias("b"), x["m"].alias("m"), x["g"].alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["b"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (begin + x["m"]).alias("stop"))
        return F.struct((begin + x["m"]).alias("at"), F.when(x["g"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(zipped, start, step, lambda acc: acc["spans"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(SPAN))


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], text: str, spans: str) -> DataFrame:
    """docs with two more columns: the text (null: empty) and all its spans, (start, order, kind, stop) by start, then rule.

    Documents meet their candidate kinds in one join on doc_id, whose keys hold one row each, so that hot sources or
    copies don't gather anywhere.
    """
    key, kinds = fresh(docs, "id", "kinds")
    index = stored(candidates(postings(docs, trigrams(rules)), rules), "secret-candidates")
    index = index.select(F.col("doc_id").alias(key), F.col("kinds").alias(kinds))
    joined = docs.withColumn(text, F.coalesce("text", F.lit(""))).join(index, docs["doc_id"].cast("long").eqNullSafe(index[key]), "left")
    found = []
    for i, rule in enumerate(rules):
        one = rule_spans(F.col(text), rule, i)
        if trigram_query(rule.pattern):
            one = F.when(F.array_contains(kinds, rule.kind), one).otherwise(F.array().cast(SPAN))
        found.append(one)
    return joined.withColumn(spans, F.array_sort(F.concat(*found))).drop(key, kinds)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text (null: empty) and spans, all secrets of each row: (start, order, kind, stop) by start, then rule.

    One row per row of docs, repeated rows too; rows with one id share their postings, which only widens the search.
    A null doc_id is an id like any other.  An empty table gives no rows.
    """
    return _scanned(texts_of(docs), rules, "whole", "spans").select("doc_id", F.col("whole").alias("text"), "spans")


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs; see secret_spans for odd rows."""
    found = secret_spans(docs)
    base = F.filter("spans", lambda x: x["order"] < len(BASE))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced by mark (secrets that overlap: by one mark) and n_chars set anew.

    All other columns and all rows stay, repeated rows too.  A null text stays null.  The clean text comes from the
    projection that finds the spans, so texts move once at most.
    """
    whole, spans, clean = fresh(docs, "whole", "spans", "clean")
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh_part = F.concat(acc["out"], F.col(whole).substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.when(x["start"] >= acc["at"], F.struct(x["stop"].alias("at"), fresh_part.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), acc["out"].alias("out")))

    new = F.aggregate(spans, empty, step, lambda acc: F.concat(acc["out"], F.col(whole).substr(acc["at"] + 1, F.length(whole))))
    out = _scanned(docs, RULES, whole, spans).withColumn(clean, F.when(F.size(spans) > 0, new))
    change = {"text": F.coalesce(clean, "text")}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(F.col(clean).isNotNull(), F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[change[c].alias(c) if c in change else F.col(f"`{c}`") for c in docs.columns])
