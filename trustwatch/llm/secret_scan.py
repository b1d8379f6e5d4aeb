"""Operator 6: secret scans through a trigram index, in DataFrame operations only.

Each rule's regular expression is read once (on the driver: rules are few and short) into a Boolean trigram query, an AND of ORs
of ANDs: every alternative of every literal run that a match must contain. The index holds, for each trigram that some rule asks
for, the documents that have it; postings are intersected per rule and clause by counting, and only candidates are verified with
the expression. Rules without a mandatory trigram scan all documents.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustwatch.llm.stage import id_text

try:
    from re import _constants as C, _parser
except ImportError:  # pragma: no cover
    import sre_constants as C
    import sre_parse as _parser


@dataclass(frozen=True)
class Rule:
    """kind; expression; the group that must have at least ``least`` code points (0: the match); whether letters match in either case."""

    kind: str
    regex: str
    group: int
    least: int
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.regex


BASE = [
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
]
ADDED = [
    Rule("key_block", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", 0, 36),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 40),
    Rule("url_login", "[a-z][a-z0-9+]*://[^/\\s:@]+:[^/\\s:@]+@", 0, 0),
]
RULES = BASE + ADDED
MOST_STRINGS = 64


def literal_strings(regex: str) -> list[set[str]]:
    """Sets of strings, of each of which a match contains at least one: maximal literal runs with small alternatives expanded."""
    found: list[set[str]] = []

    def walk(items) -> None:
        run: set[str] | None = {""}

        def close() -> None:
            nonlocal run
            if run and "" not in run:
                found.append(run)
            run = {""}

        for op, arg in items:
            option = strings(op, arg)
            if option is not None and len(run) * len(option) <= MOST_STRINGS:
                run = {a + b for a in run for b in option}
                continue
            close()
            if option is not None:
                run = set(option)
            elif op is C.SUBPATTERN:
                walk(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                walk(arg[2])
        close()

    def strings(op, arg) -> set[str] | None:
        """All strings of this part, if they are few."""
        if op is C.LITERAL:
            return {chr(arg)}
        if op is C.IN:
            out: set[str] = set()
            for o, a in arg:
                if o is not C.LITERAL:
                    return None
                out.add(chr(a))
            return out
        if op is C.SUBPATTERN:
            return joined(arg[3])
        if op is C.BRANCH:
            out = set()
            for b in arg[1]:
                s = joined(b)
                if s is None:
                    return None
                out |= s
            return out if len(out) <= MOST_STRINGS else None
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            s = joined(arg[2])
            return None if s is None else s | {""} if arg[0] == 0 else s
        return None

    def joined(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            s = strings(op, arg)
            if s is None or len(out) * len(s) > MOST_STRINGS:
                return None
            out = {a + b for a, b in itertools.product(out, s)}
        return out

    walk(_parser.parse(regex))
    return found


def trigram_query(rule: Rule) -> list[list[frozenset[str]]]:
    """Clauses (all must hold) of alternatives (one must) of trigrams (all must occur); empty: nothing is mandatory."""
    clauses = []
    for options in literal_strings(rule.regex):
        sets = []
        for s in sorted(options):
            s = s.lower() if rule.any_case else s
            sets.append(frozenset(s[i:i + 3] for i in range(len(s) - 2)))
        if sets and all(sets):
            clauses.append(sets)
    return clauses


def _asked(rules: list[Rule]) -> list[tuple[str, bool]]:
    return sorted({(t, r.any_case) for r in rules for clause in trigram_query(r) for alt in clause for t in alt})


def trigram_index(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Postings (doc_id, trigram, folded): the documents that contain each trigram that the rules ask for (folded: of the text with A-Z lower-cased)."""
    text, low = F.col("text"), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = [F.when((F.col("low") if folded else text).contains(t), F.struct(F.lit(t).alias("trigram"), F.lit(folded).alias("folded"))) for t, folded in _asked(rules)]
    if not has:
        return docs.select("doc_id", F.lit("").alias("trigram"), F.lit(False).alias("folded")).limit(0)
    return id_text(docs).withColumn("low", low).select("doc_id", F.explode(F.array_compact(F.array(*has))).alias("p")).select("doc_id", "p.trigram", "p.folded")


def candidates(index: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, kinds): the rules whose Boolean query a document's postings fulfil. Postings are gathered per document, at most one per asked trigram."""
    have = index.groupBy("doc_id").agg(F.collect_set(F.concat(F.when(F.col("folded"), "~").otherwise("="), "trigram")).alias("have"))
    met = []
    for r in rules:
        query = trigram_query(r)
        if query:
            mark = "~" if r.any_case else "="
            ok: Column = F.lit(True)
            for clause in query:
                one: Column = F.lit(False)
                for alt in clause:
                    wanted = F.array(*[F.lit(mark + t) for t in sorted(alt)])
                    one = one | (F.size(F.array_intersect(wanted, F.col("have"))) == len(alt))
                ok = ok & one
            met.append(F.when(ok, F.lit(r.kind)))
    return have.select("doc_id", F.array_compact(F.array(*met)).alias("kinds")).filter(F.size("kinds") > 0) if met else have.select("doc_id", F.array().cast("array<string>").alias("kinds")).limit(0)


def _spans(rule: Rule) -> Column:
    """Array of (start, end, kind) of one rule's matches, in code points: the pieces between the matches give the places."""
    rank = RULES.index(rule) if rule in RULES else len(RULES)
    pattern = F.lit(rule.java)
    match = F.regexp_extract_all("text", pattern, F.lit(0))
    part = F.split("text", rule.java, -1)
    size = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else match
    zipped = F.zip_with(F.zip_with(match, size, lambda m, s: F.struct(F.char_length(m).alias("n"), F.char_length(s).alias("inner"))), part, lambda m, p: F.struct(F.char_length(p).alias("gap"), m["n"].alias("n"), m["inner"].alias("inner")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>").alias("got"))

    def step(a, m):
        s = a["at"] + m["gap"]
        e = s + m["n"]
        one = F.array(F.struct(s.alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(F.coalesce(e, a["at"]).alias("at"), F.when(m["inner"] >= rule.least, F.concat(a["got"], one)).otherwise(a["got"]).alias("got"))

    return F.aggregate(zipped, start, step)["got"]


def _quick(rule: Rule) -> Column:
    """A condition that any kept match fulfils, cheaper than finding all matches."""
    if rule.kind == "hex":
        return F.col("text").rlike("[0-9a-f]{32}")
    return F.col("text").rlike(rule.java)


def scan(docs: DataFrame, rules: list[Rule] = RULES, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, the columns of ``keep`` and spans (array of start, rank, end, kind by start, then rule order) of each row.

    Null texts are empty and have no spans; rows without a doc_id are left out; repeated rows are scanned each; extra columns are ignored.
    """
    rows = id_text(docs, *(keep or []))
    free = [r for r in rules if not trigram_query(r)]
    held = candidates(trigram_index(docs, rules), rules)
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    found = rows.join(held, "doc_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    parts = []
    for r in rules:
        ask = _quick(r) if r in free else F.array_contains("kinds", r.kind) & _quick(r)
        parts.append(F.when(ask, _spans(r)).otherwise(none))
    return found.select("doc_id", "text", *(keep or []), F.array_sort(F.concat(*parts)).alias("spans"))


def redact(docs: DataFrame, rules: list[Rule] = RULES, keep: list[str] | None = None) -> DataFrame:
    """doc_id and text with every span replaced by [kind]; overlapping spans give the first one's mark."""
    one = scan(docs, rules, keep)
    cut = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substr("text", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).otherwise(a["out"]).alias("out")))
    return one.withColumn("cut", cut).select("doc_id", *(keep or []), F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(F.col("cut.out"), F.expr("substring(text, CAST(cut.at AS INT) + 1)"))).alias("text"))
