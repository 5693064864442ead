"""Secret scans by an inverted index of trigrams, in DataFrame functions alone.

Each rule's regular expression is turned into a Boolean query over the trigrams (of lower-cased
text) that any match must hold: an OR of ANDs. Texts post the trigrams that occur in any query;
the postings of each AND are intersected by a count per text; only texts that a query admits
are searched with the rule's expression. A rule without mandatory trigrams searches every text.

A text's key in the index is a hash of its contents and of a part of its id. Texts that share
a key only share candidates, which the search verifies, and the part of the id keeps the copies
of one text from meeting in one task.

Matches are leftmost and non-overlapping for each rule; a rule may ask for a least length of a
group, and matches that fail it are dropped after the search. Positions count code points.

Defined results: a null or empty text has no match. Ids may be null or repeat; each row is
scanned by itself. No other column of the table is read unless passed on.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, PARTS = "[SECRET]", 64
_SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The rules in order. The first three are the base rules.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # maximal runs either way
)
#: Added by this scan: fixed public formats.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@"),
)
RULES = BASE + ADDED

# ------------------------------------------------------------------ trigram queries

_MOST_STRINGS, _MOST_SIGNS = 64, 16
Query = frozenset  # of frozensets of trigrams: an OR of ANDs; {frozenset()} admits everything
_ALL: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    out = {x | y for x in a for y in b}
    if len(out) > _MOST_STRINGS:
        return a if len(a) <= len(b) else b  # either alone is still mandatory
    return frozenset(x for x in out if not any(y < x for y in out))


def _of(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return _ALL
    out = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(x for x in out if not any(y < x for y in out))


def _strings(op, value) -> set[str] | None:
    """All lower-cased strings that an element matches, if they are few."""
    if op is K.LITERAL:
        return {chr(value).lower()}
    if op is K.IN:
        signs: set[str] = set()
        for o, v in value:
            if o is K.LITERAL:
                signs.add(chr(v).lower())
            elif o is K.RANGE and v[1] - v[0] < 4 * _MOST_SIGNS:
                signs.update(chr(c).lower() for c in range(v[0], v[1] + 1))
            else:
                return None
        return signs if len(signs) <= _MOST_SIGNS else None
    if op is K.SUBPATTERN:
        return _sequence_strings(value[3])
    if op is K.BRANCH:
        parts = [_sequence_strings(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op is K.MAX_REPEAT and value[1] <= 2:
        one = _sequence_strings(value[2])
        out = {""} if value[0] == 0 else set()
        for k in range(max(value[0], 1), value[1] + 1):
            out |= {x * k for x in one} if one is not None and (k == 1 or len(one) == 1) else {None}
        return None if one is None or None in out else out
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for op, value in items:
        more = _strings(op, value)
        if more is None or len(out) * len(more) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(items) -> Query:
    out, run = _ALL, {""}
    for op, value in items:
        more = _strings(op, value)
        if more is not None and len(run) * len(more) <= _MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        out, run = _both(out, _of(run)), {""}
        if more is not None:
            run = more
        elif op is K.SUBPATTERN:
            out = _both(out, _query(value[3]))
        elif op is K.BRANCH:
            out = _both(out, frozenset().union(*[_query(x) for x in value[1]]))
        elif op is K.MAX_REPEAT and value[0] > 0:
            out = _both(out, _query(value[2]))
    return _both(out, _of(run))


def trigram_query(regex: str) -> Query:
    """The OR of ANDs of lower-cased trigrams that every match of ``regex`` satisfies."""
    q = _query(list(parser.parse(regex)))
    return _ALL if frozenset() in q else q


# ------------------------------------------------------------------ index and search

def postings(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """``(gram, key)``: which texts (``key``, ``whole``) hold which of the trigrams."""
    low = keyed.select("key", F.lower("whole").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), g) for g in grams]))
    return low.select("key", F.explode(present).alias("gram"))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(key, kinds)``: the rules whose query each text satisfies; scanning rules not listed."""
    clauses = [(r.kind, f"{r.kind} {i}", g, len(c)) for r in rules for i, c in enumerate(sorted(trigram_query(r.regex), key=sorted)) for g in sorted(c)]
    spark = keyed.sparkSession
    if not clauses:
        return spark.createDataFrame([], "key long, kinds array<string>")
    asked = spark.createDataFrame(clauses, "kind string, clause string, gram string, needed int")
    posted = postings(keyed, sorted({c[2] for c in clauses}))
    met = (posted.join(F.broadcast(asked), "gram")  # a few rows for each rule
           .groupBy("key", "kind", "clause", "needed").agg(F.count_distinct("gram").alias("n")).where("n = needed"))
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """``array<struct<start, kind, end>>`` of the rule's matches, from what lies between them."""
    regex = F.lit(rule.regex)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    asked = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.regex, -1)
    lengths = F.arrays_zip(F.slice(F.transform(between, F.length), F.lit(1), F.size(found)).alias("gap"), F.transform(found, F.length).alias("size"), F.transform(asked, F.length).alias("asked"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc, x):
        s = acc["at"] + x["gap"]
        e = s + x["size"]
        span = F.array(F.struct(s.alias("start"), F.lit(number).alias("kind"), e.alias("end")))
        kept = F.when(x["asked"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"])
        return F.struct(e.alias("at"), kept.alias("out"))

    # the same text may hold nothing, which is quicker to see than to take apart
    return F.when(text.rlike(rule.regex), F.aggregate(lengths, start, step)["out"])


def _keyed(docs: DataFrame, passed: list[str]) -> tuple[DataFrame, list[str]]:
    names = [f"c{i}" for i in range(len(passed))]
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for x, c in zip(names, passed)], whole.alias("whole"), F.col("doc_id").alias("part"))
    return rows.withColumn("key", F.xxhash64("whole", F.pmod(F.xxhash64("part"), F.lit(PARTS)))).drop("part"), names


def _searched(docs: DataFrame, rules: tuple[Rule, ...], passed: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows with ``whole`` and ``kinds``, the rules to try on them besides those that scan."""
    keyed, names = _keyed(docs, passed)
    found = candidates(keyed.select("key", "whole"), rules)
    return keyed.join(found, "key", "left"), names


def _tried(rule: Rule) -> Column:
    if trigram_query(rule.regex) == _ALL:
        return F.lit(True)
    return F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, passed: list[str] | None = None) -> DataFrame:
    """The ``passed`` columns (default ``doc_id``) and ``spans``, one row for each document.

    ``spans`` is an array of ``(start, kind, end)`` by start, then by the rule's place in
    ``rules`` (``kind`` is that place); ends are exclusive.
    """
    passed = ["doc_id"] if passed is None else passed
    rows, names = _searched(docs, rules, passed)
    none = F.array().cast(_SPANS)
    each = [F.coalesce(F.when(_tried(r), _spans(F.col("whole"), r, i)), none) for i, r in enumerate(rules)]
    return rows.select(*[F.col(x).alias(c) for x, c in zip(names, passed)], F.array_sort(F.concat(*each)).alias("spans"))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = MARK) -> DataFrame:
    """``docs`` with every match replaced by ``mark``, rule by rule; ``n_chars`` follows if it is there."""
    rows, names = _searched(docs, rules, docs.columns)
    rows = rows.withColumn("clean", F.col("whole"))
    for r in rules:
        text, regex = F.col("clean"), F.lit(r.regex)
        found = F.regexp_extract_all(text, regex, F.lit(0))
        asked = F.regexp_extract_all(text, regex, F.lit(r.group)) if r.group else found
        put = F.zip_with(found, asked, lambda x, y: F.when(F.length(y) >= r.least, F.lit(mark)).otherwise(x))
        new = F.concat_ws("", F.flatten(F.zip_with(F.split(text, r.regex, -1), put, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
        rows = rows.withColumn("clean", F.when(_tried(r) & text.rlike(r.regex), new).otherwise(text))
    out = []
    for x, c in zip(names, docs.columns):
        value = F.col(x)
        if c == "text":
            value = F.when(value.isNull(), value).otherwise(F.col("clean"))
        elif c == "n_chars":
            value = F.when(F.col("clean") != F.col("whole"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return rows.select(*out)
