"""Secret scans with a trigram inverted index, in built-in functions only.

A Boolean trigram query is derived from each rule's regex: an OR over the texts that
a mandatory part of it can match, each an AND of that text's trigrams.  The index has
a posting (trigram, doc_id) for the trigrams that queries ask; postings are
intersected per document, as bits.  Only candidates are
verified with the regex.  A rule without mandatory trigrams scans every text.

Null texts count as empty.  Rows without a doc_id are not in the index and are
verified for every rule.  Repeated ids share postings, which only adds candidates.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common

MOST_STRINGS = 64
#: Matches of one text are placed in blocks of so many, so that the work is linear in their number.
MATCH_BLOCK = 128


@dataclass(frozen=True)
class Rule:
    """group and least: a match counts if that group has so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The kinds that the scan's contract lists, in its order.  Runs that are
# bounded below are maximal in either form, so the bound stands in the pattern for two.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which every match has in full; None if nothing is mandatory."""
    from re import _parser

    best = _best(list(_parser.parse(pattern)))
    return None if best is None else [c for c in best if not any(o < c for o in best)]


def _best(tokens: list) -> list[frozenset[str]] | None:
    """The clauses of the part of a sequence that demands the most trigrams."""
    options, held = [], {""}
    for op, arg in [*tokens, ("end", None)]:
        strings = _strings(op, arg)
        grown = None if strings is None else {a + b for a in held for b in strings}
        if grown is not None and len(grown) <= MOST_STRINGS:
            held = grown
            continue
        if all(len(s) >= 3 for s in held):
            options.append(list({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in held}))
        if str(op) == "SUBPATTERN" and (inner := _best(list(arg[-1]))) is not None:
            options.append(inner)
        held = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}
    return max(options, key=lambda clauses: min(map(len, clauses)), default=None)


def _strings(op, arg) -> set[str] | None:
    """All texts that a token can match, in lower case; None if too many."""
    kind = str(op)
    if kind == "LITERAL":
        return {chr(arg).lower()}
    if kind == "IN":
        found: set[str] = set()
        for k, v in arg:
            if str(k) == "LITERAL":
                found.add(chr(v).lower())
            elif str(k) == "RANGE" and v[1] - v[0] < 4:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if kind == "SUBPATTERN":
        return _all(list(arg[-1]))
    if kind == "BRANCH":
        parts = [_all(list(p)) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
        inner = _all(list(arg[2]))
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _all(tokens: list) -> set[str] | None:
    held = {""}
    for op, arg in tokens:
        strings = _strings(op, arg)
        if strings is None or len(held) * len(strings) > MOST_STRINGS:
            return None
        held = {a + b for a in held for b in strings}
    return held


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the asked trigrams over whole lower-cased texts."""
    lowered = docs.where(docs["doc_id"].isNotNull()).select("doc_id", F.lower(common.text_of(docs)).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return lowered.select("doc_id", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, kinds): the rules of which some clause's postings all have the document.

    Postings are intersected as bits: a document's are or-ed, map-side first, into masks
    of 63 trigrams, and a clause is met if the masks have all its bits.
    """
    number = {t: i for i, t in enumerate(sorted({t for q in queries.values() for c in q for t in c}))}
    bits = [(t, i // 63, 1 << i % 63) for t, i in number.items()]
    asked = index.sparkSession.createDataFrame(bits, "term string, word int, bit long")  # a row for each trigram of the rules
    joined = index.join(F.broadcast(asked), index["trigram"] == asked["term"])
    words = range(max(w for _, w, _ in bits) + 1)
    masks = joined.groupBy("doc_id").agg(*[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"mask{w}") for w in words])

    def met(clause: frozenset[str]) -> Column:
        needed = [sum(1 << number[t] % 63 for t in clause if number[t] // 63 == w) for w in words]
        return reduce(lambda a, b: a & b, [F.col(f"mask{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in enumerate(needed) if m])

    kinds = [F.when(reduce(lambda a, b: a | b, map(met, clauses)), F.lit(kind)) for kind, clauses in queries.items()]
    return masks.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def spans(text: str, rule: Rule, number: int) -> Column:
    """array<struct<start, number, end, kind>> of the rule's leftmost non-overlapping matches.

    Lengths of the matches and of the gaps before them are folded into positions block
    by block; a second fold over the blocks' lengths moves each block to its place.
    """
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    steps = F.arrays_zip(between.alias("gap"), whole.alias("long"), tested.alias("counts"))
    kind = "struct<start:int,number:int,end:int,kind:string>"
    none = F.array().cast(f"array<{kind}>")

    def step(state, x):
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["long"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind")).cast(kind)
        return F.struct(end.alias("at"), F.when(x["counts"], F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    def placed(steps):
        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), step)

    def moved(block, by):
        return F.transform(block["found"], lambda x: F.struct((x["start"] + by).alias("start"), x["number"].alias("number"), (x["end"] + by).alias("end"), x["kind"].alias("kind")))

    def in_blocks(steps):
        starts = F.sequence(F.lit(1), F.size(steps), F.lit(MATCH_BLOCK))
        blocks = F.transform(starts, lambda i: placed(F.slice(steps, i, F.lit(MATCH_BLOCK))))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        bases = lambda blocks: F.aggregate(blocks, zero, lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found")), lambda s: s["found"])
        # A one-element array binds the blocks to a name, so they are folded once.
        return F.flatten(F.flatten(F.transform(F.array(blocks), lambda held: F.zip_with(held, bases(held), moved))))

    made = F.flatten(F.transform(F.array(steps), lambda held: F.when(F.size(held) <= MATCH_BLOCK, placed(held)["found"]).otherwise(in_blocks(held))))
    return F.when(F.col(text).rlike(rule.pattern), made).otherwise(none)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text, found): all spans of every row by start, then by the rules' order."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    texts = docs.select("doc_id", common.text_of(docs).alias("text"))
    if queries:
        wanted = candidates(build_index(docs, trigrams), queries).withColumnRenamed("doc_id", "of_id")
        texts = texts.join(wanted, texts["doc_id"] == wanted["of_id"], "left").drop("of_id")
    parts = []
    for number, rule in enumerate(rules):
        found = spans("text", rule, number)
        if rule.kind in queries:
            asked = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) | F.col("doc_id").isNull()
            found = F.when(asked, found).otherwise(F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>"))
        parts.append(found)
    return texts.select("doc_id", "text", F.sort_array(reduce(lambda a, b: F.concat(a, b), parts)).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from a scan."""
    base = F.filter("found", lambda x: x["number"] < len(BASE))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(r.kind).alias(f"n_{r.kind}") for r in BASE]
    return scanned.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(common.table(spark, sf_dir, "documents")))


def brute_spans(text: str, rules: tuple[Rule, ...] = BASE) -> list[tuple[str, int, int]]:
    """The plain meaning of a scan, for tests."""
    found = [(m.start(), i, m.end(), r.kind) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text, re.ASCII) if len(m[r.group]) >= r.least]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]
