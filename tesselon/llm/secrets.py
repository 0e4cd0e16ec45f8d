"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regex is turned, on the driver, into a Boolean query of trigrams that any match must hold. Postings of
those trigrams are intersected per document; only candidates are verified with the regex. A rule without mandatory
trigrams is run over every document.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm.shared import free_name, stored

MOST, STRETCH = 64, 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``least``: the shortest value of ``group`` that counts; shorter matches are consumed and dropped.

    ``tail``: what a span takes in behind a match of ``regex``, if it is there; it never decides whether there is a match.
    """

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    tail: str = ""


# A key behind its header: up to the END line, without passing another line of five hyphens; where that is missing, the
# base64 lines that follow and a short last one. Line breaks may be escaped, as in source code and JSON.
PEM_BREAK = r"""(?:\\[rn]|[\s"'])"""
PEM_TAIL = (
    r"(?:[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    rf"|(?:{PEM_BREAK}*+(?:[A-Za-z][A-Za-z-]{{0,30}}: [^\r\n\\]{{0,200}}{PEM_BREAK}++){{0,4}}(?:{PEM_BREAK}{{0,40}}[A-Za-z0-9+/=]{{16,}}+)++"
    rf"(?:(?:\\[rn]|[\r\n])++[ \t]*+[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?=[ \t\"']*(?:[\r\n]|\\[rn]|$)))?))?"
)

# The rules. The first three are the base kinds, in the order in which ties are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", tail=PEM_TAIL),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")


def _all_of(parts: list) -> list | None:
    """Conjunction of queries in disjunctive form (a list of trigram sets); None says nothing."""
    out = None
    for q in parts:
        if q is None:
            continue
        out = q if out is None else [a | b for a in out for b in q]
        if len(out) > MOST:
            return None
    return out


def _of_words(words: set[str]) -> list | None:
    """Some of ``words`` occurs: one clause per word, none at all if a word is too short to say anything."""
    if not words or any(len(w) < 3 for w in words):
        return None
    return [frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in sorted(words)]


def _members(items) -> set[str] | None:
    """The lower-cased characters of a class, or None for a class too wide to spell out."""
    found: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, list | None]:
    """For a sequence: the exact lower-cased strings it matches if those are few, and the query that any match fulfils."""
    exact: set[str] | None = {""}
    run, known, parts = {""}, True, []
    for op, arg in nodes:
        words, query = None, None
        if op is sre.LITERAL:
            words = {chr(arg).lower()}
        elif op is sre.IN:
            words = _members(arg)
        elif op is sre.SUBPATTERN:
            words, query = _walk(arg[3])
        elif op is sre.BRANCH:
            each = [_walk(b) for b in arg[1]]
            words = set().union(*(e[0] for e in each)) if all(e[0] is not None for e in each) else None
            queries = [q if w is None else _of_words(w) for w, q in each]
            query = None if any(q is None for q in queries) else [c for q in queries for c in q]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, needed = _walk(body)
            if inner is not None and low == 0 and high == 1:
                words = inner | {""}
            elif inner is not None and low == high and low <= 8:
                words = {""}
                for _ in range(low):
                    words = {a + b for a in words for b in inner} if len(words) * len(inner) <= MOST else None
                    if words is None:
                        break
            query = (needed if inner is None else _of_words(inner)) if low else None
        if words is not None and len(words) * len(run) <= MOST:
            run = {a + b for a in run for b in words}
        else:
            parts += [_of_words(run), query if words is None else _of_words(words)]
            run, known = {""}, False
    parts.append(_of_words(run))
    return (run if known else None), _all_of(parts)


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Clauses of lower-cased trigrams: each match lies in a text that holds all trigrams of some clause. None: no such set.

    A clause that asks for more than another one does is absorbed by it.
    """
    exact, query = _walk(sre_parser.parse(regex))
    query = _of_words(exact) if exact is not None else query
    return None if query is None else [c for c in dict.fromkeys(query) if not any(d < c for d in query)]


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def pieces_of(text: Column, rule: Rule) -> Column:
    """Array of ``(m, gap, v)``: each match of ``rule`` with its tail, the text before it and the value that has to be long enough."""
    regex = rule.regex + rule.tail
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(regex), F.lit(rule.group))
    pieces = F.arrays_zip(whole.alias("m"), F.split(text, regex, -1).alias("gap"), value.alias("v"))
    found = F.filter(pieces, lambda x: x["m"].isNotNull())
    return F.when(F.regexp_like(text, F.lit(rule.regex)), found).otherwise(F.slice(found, 1, 0))


def in_stretches(pieces: Column) -> Column:
    """An array cut into arrays of STRETCH elements: what grows step by step stays short in each of them."""
    last = F.floor((F.size(pieces) - 1) / F.lit(STRETCH))
    return F.when(F.size(pieces) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.slice(pieces, (i * STRETCH + 1).cast("int"), F.lit(STRETCH)))).otherwise(F.array().cast("array<array<struct<m:string,gap:string,v:string>>>"))


def stretch_starts(stretches: Column) -> Column:
    """Where in the text each stretch of pieces begins."""
    wide = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["gap"]) + F.length(x["m"]))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("found"))
    step = lambda acc, c: F.struct((acc["at"] + wide(c)).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found"))
    return F.aggregate(stretches, start, step, lambda acc: acc["found"])


def spans_of(stretches: Column, starts: Column, rule: Rule, rank: int) -> Column:
    """Array of ``(start, rank, kind, end)`` in code points: leftmost non-overlapping matches of ``rule``, tails included."""

    def step(acc, x):
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), e.cast("bigint").alias("end")))
        kept = F.when(F.length(x["v"]) >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"])
        return F.struct(e.cast("bigint").alias("at"), kept.alias("found"))

    def spans(stretch, at):
        return F.aggregate(stretch, F.struct(at.alias("at"), F.array().cast(SPANS).alias("found")), step, lambda acc: acc["found"])

    return F.flatten(F.zip_with(stretches, starts, spans))


def candidates(texts: DataFrame, rules=RULES) -> DataFrame:
    """``(key, rules)``: for each distinct text the ranks of the rules whose trigram query it fulfils.

    ``texts(key, text)``. The index holds the postings of the trigrams that some rule asks for, one per text, and is
    intersected by counting, clause by clause. The table of clauses is as small as the rule set.
    """
    clauses = [
        (r, c, t, 1 << k, (1 << len(clause)) - 1)
        for r, rule in enumerate(rules)
        for c, clause in enumerate(trigram_query(rule.regex) or ())
        for k, t in enumerate(sorted(clause))
    ]
    wanted = F.array(*[F.lit(t) for t in sorted({c[2] for c in clauses})])
    low = texts.select("key", lowered(F.col("text")).alias("low"))
    postings = low.select("key", F.explode(F.filter(wanted, lambda t: F.col("low").contains(t))).alias("trigram"))
    asked = texts.sparkSession.createDataFrame(clauses, "rule int, clause int, trigram string, bit bigint, full bigint")
    met = postings.join(F.broadcast(asked), "trigram").groupBy("key", "rule", "clause", "full").agg(F.bit_or("bit").alias("held"))
    return met.where("held = full").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def secret_spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: all spans ``(start, rank, kind, end)`` by start, then kind in the order of ``rules``.

    Offsets are code points, end exclusive. A null text counts as empty. Every row is scanned on its own, so repeated
    ids, null ids and extra columns of any name are harmless (a column ``secret_spans`` is replaced). Candidates are keyed by the
    digest of the text, so copies share one index entry. The candidates are written before they are joined: where they
    stay under the session's broadcast threshold no text is shuffled, beyond it AQE can split the rows of many copies.
    The time for a text grows little faster than the number of its matches.
    """
    docs = docs.drop("secret_spans")
    key, asked = free_name(docs, "key"), free_name(docs, "asked")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    found = stored(candidates(docs.select(F.unhex(F.md5("text")).alias("key"), "text").where("text is not null"), rules), "candidates")
    joined = keyed.join(found.select(F.col("key").alias(key), F.col("rules").alias(asked)), key, "left")
    text, ranks = F.coalesce("text", F.lit("")), range(len(rules))
    none = F.array().cast("array<struct<m:string,gap:string,v:string>>")
    made = {name: [free_name(docs, f"{name}{k}") for k in ranks] for name in ("pieces", "stretches", "starts")}
    first = []
    for k, rule in enumerate(rules):
        pieces = pieces_of(text, rule)
        first.append(pieces if trigram_query(rule.regex) is None else F.when(F.array_contains(asked, k), pieces).otherwise(none))
    steps = joined.withColumns(dict(zip(made["pieces"], first)))
    steps = steps.withColumns({made["stretches"][k]: in_stretches(F.col(made["pieces"][k])) for k in ranks})
    steps = steps.withColumns({made["starts"][k]: stretch_starts(F.col(made["stretches"][k])) for k in ranks})
    each = [spans_of(F.col(made["stretches"][k]), F.col(made["starts"][k]), rule, k) for k, rule in enumerate(rules)]
    return steps.select(*docs.columns, F.array_sort(F.concat(*each)).alias("secret_spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts of the base kinds, the digest of the base spans and the list of all spans.

    Null and empty texts have none; other columns than ``doc_id`` and ``text`` are not read.
    """
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    of_kind = lambda k: F.size(F.filter(spans, lambda s: s["rank"] == k)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return secret_spans(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; overlapping spans become one. Texts without one stay as they are,
    null ones included; repeated rows, null ids and extra columns of any name are harmless, an empty table gives an empty result."""
    found = secret_spans(docs)
    begins, ends, heads = (free_name(found, name) for name in ("begins", "ends", "heads"))
    text, size = F.col("text"), F.size("secret_spans")
    found = found.withColumns({begins: F.array_sort(F.transform("secret_spans", lambda s: s["start"])), ends: F.array_sort(F.transform("secret_spans", lambda s: s["end"]))})
    # The first i spans have all ended before the next one starts if and only if the i-th smallest end lies no later.
    numbers = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    found = found.withColumn(heads, F.filter(numbers, lambda i: (i == 0) | (F.get(begins, i) >= F.get(ends, i - 1))))
    cuts, many = F.col(heads), F.size(heads)
    after = lambda g: F.when(g == 0, F.lit(0)).otherwise(F.get(ends, F.get(cuts, g) - 1))
    after_all = F.get(ends, size - 1)
    until = lambda g: F.when(g == many, F.length(text)).otherwise(F.get(begins, F.get(cuts, g)))
    since = lambda g: F.when(g == many, after_all).otherwise(after(g))
    piece = lambda whole, a, b: F.substring(whole, (a + 1).cast("int"), (b - a).cast("int"))

    def stretch(c):
        low, high = c * STRETCH, F.least(c * STRETCH + STRETCH - 1, many)
        held = F.array(F.struct(piece(text, since(low), until(high)).alias("part"), since(low).cast("bigint").alias("at")))
        return F.flatten(F.transform(held, lambda h: F.transform(F.sequence(low, high), lambda g: piece(h["part"], since(g) - h["at"], until(g) - h["at"]))))

    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.floor(many / F.lit(STRETCH)).cast("int")), stretch))
    return found.withColumn("text", F.when(size > 0, F.array_join(whole, mark)).otherwise(text)).drop("secret_spans", begins, ends, heads)
