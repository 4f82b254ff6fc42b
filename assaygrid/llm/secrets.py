"""Secret scan with a trigram inverted index.

Every rule is a regular expression. Its mandatory trigrams are derived from the expression as a Boolean query
in disjunctive form; postings (trigram, document) are built for the trigrams that any rule asks for, over the
text in lower case; a rule's candidates are the documents whose postings satisfy one conjunction of its query.
Only candidates are read by the expression itself. A rule without mandatory trigrams reads every document.

Defined results: a null text counts as empty and has no span; equal rows get equal results; nothing in a text's
length changes the method; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm.common import fresh, row_key, whole
from assaygrid.plans.bind import Catalog, table

catalog = Catalog()
RUN = 256  # numbers that grow element by element in a running sum
ALTERNATIVES = 64  # strings kept apart while a query is derived; beyond it the query gets weaker, never wrong


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and do not overlap; those whose ``group`` is short are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


def either(word: str) -> str:
    """A pattern for an ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
ASSIGN = f"({KEYWORDS})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Rule("assign", ASSIGN, 2, 6), Rule("access", "AKIA[A-Z0-9]+", 0, 20), Rule("hex", "[0-9a-f]+", 0, 24))
# Prefixes that issuers publish for their keys.
ISSUED = (
    Rule("forge", "gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("cloud", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ISSUED


# --- Boolean trigram queries -------------------------------------------------------------------------------

Query = frozenset  # of conjunctions, each a frozenset of trigrams; {frozenset()} holds always
ALWAYS: Query = frozenset([frozenset()])


def both(a: Query, b: Query) -> Query:
    joined = {x | y for x, y in product(a, b)}
    return frozenset(q for q in joined if not any(other < q for other in joined)) if len(joined) <= ALTERNATIVES else a


def spelled(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings(node) -> set[str] | None:
    """All strings that one parsed element can be, in lower case, or None if there are too many."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and arg[0][0] is not sre.NEGATE:
        found = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                found.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence_strings(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 2:
        once = _sequence_strings(arg[2])
        return None if once is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(once, repeat=n)}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(out) * len(part) > ALTERNATIVES:
            return None
        out = {a + b for a, b in product(out, part)}
    return out


def _required(nodes) -> Query:
    query, run = ALWAYS, {""}

    def closed(query: Query, run: set[str]) -> Query:
        return both(query, frozenset(map(spelled, run)))

    for node in nodes:
        part = _strings(node)
        if part is not None and len(run) * len(part) <= ALTERNATIVES:
            run = {a + b for a, b in product(run, part)}
            continue
        query, run = closed(query, run), {""}
        op, arg = node
        if op is sre.SUBPATTERN:
            query = both(query, _required(arg[3]))
        elif op is sre.BRANCH:
            query = both(query, frozenset().union(*map(_required, arg[1])))
        elif op is sre.MAX_REPEAT and arg[0] >= 1:
            query = both(query, _required(arg[2]))
    return closed(query, run)


def trigram_query(regex: str) -> list[list[str]]:
    """Conjunctions of trigrams, in lower case, of which every match satisfies one; empty if none is mandatory."""
    found = _required(_parser.parse(regex))
    found = {q for q in found if not any(other < q for other in found)}
    return [] if frozenset() in found else sorted(map(sorted, found))


# --- index, candidates, verification -----------------------------------------------------------------------


def postings(docs: DataFrame, trigrams: Sequence[str], key: str, text: Column) -> DataFrame:
    """The inverted index for the given trigrams: one row (trigram, ``key``) per trigram a text contains."""
    low = F.lower(text)
    held = [F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in trigrams]
    lists = docs.select(key, low.alias("_low")).select(key, F.array_compact(F.array(*held)).alias("_held"))
    return lists.select(key, F.explode("_held").alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule], key: str, text: Column) -> DataFrame:
    """(``key``, rules): the kinds whose Boolean query the document's postings satisfy."""
    wanted = [(r.kind, n, t, len(c)) for r in rules for n, c in enumerate(trigram_query(r.regex)) for t in c]
    queries = docs.sparkSession.createDataFrame(wanted, "kind string, clause int, trigram string, size int")
    index = postings(docs, sorted({w[2] for w in wanted}), key, text)
    # the queries are fixed by the rules, so their table is small whatever the input
    hits = index.join(F.broadcast(queries), "trigram").groupBy(key, "kind", "clause").agg(F.countDistinct("trigram").alias("n"), F.max("size").alias("size"))
    return hits.filter("n = size").groupBy(key).agg(F.collect_set("kind").alias("rules"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` and lambdas in it refer to it."""
    return F.transform(F.array(value), use)[0]


def prefix(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``op`` over an array of numbers.

    Runs of ``RUN`` numbers grow element by element, then the results of earlier runs are added, so that an array of n numbers costs
    n RUN / 2 + (n / RUN)^2 / 2 copies and not the square of n.
    """
    grow = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, op(F.element_at(acc, -1), x)).otherwise(x)))
    none = F.array().cast("array<bigint>")

    def carried(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.get(r, F.size(r) - 1))
        before = F.concat(F.array(F.lit(None).cast("bigint")), F.aggregate(totals, none, grow))
        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), F.slice(before, 1, F.size(runs)).alias("c")), lambda x: F.transform(x["run"], lambda v: F.when(x["c"].isNull(), v).otherwise(op(x["c"], v)))))

    starts = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
    runs = lambda v: F.transform(starts(v), lambda c: F.aggregate(F.slice(v, c * RUN + 1, RUN), none, grow))
    return bound(values, lambda v: F.when(F.size(v) > 0, bound(runs(v), carried)).otherwise(none))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """(start, number, end) of the rule's matches, in code points.

    Each match is taken with the gap before it, anchored at the end of the match before; lengths add up to
    places.
    """
    pattern = F.lit(rf"\G((?s:.)*?)({rule.regex})")
    part = lambda group: F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), lambda x: F.char_length(x).cast("bigint"))
    seen = F.arrays_zip(part(1).alias("gap"), part(2).alias("n"), (part(2 + rule.group) if rule.group else part(2)).alias("least"))

    def placed(found: Column) -> Column:
        ends = prefix(F.transform(found, lambda m: m["gap"] + m["n"]), lambda a, b: a + b)
        every = F.transform(F.arrays_zip(found.alias("m"), ends.alias("end")), lambda x: F.struct((x["end"] - x["m"]["n"]).alias("start"), F.lit(number).alias("rule"), x["end"].alias("end"), x["m"]["least"].alias("least")))
        return F.transform(F.filter(every, lambda x: x["least"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["rule"].alias("rule"), x["end"].alias("end")))

    return bound(seen, placed)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``spans``: an array of (start, rule, end) by start, then by the rule's place in ``rules``."""
    key, held, spans = fresh(docs.columns, "secret_key", "secret_rules", "spans")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    found = candidates(docs.select(doc_id, text).withColumn(key, row_key(doc_id, text)), rules, key, whole(text)).withColumnRenamed("rules", held)
    none = F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")
    per_rule = []
    for number, rule in enumerate(rules):
        # a rule without mandatory trigrams reads all texts; one look for its shortest match spares the extraction
        needs = F.array_contains(F.col(held), rule.kind) if trigram_query(rule.regex) else whole(text).rlike(rule.regex if rule.least < 2 else rf"{rule.regex.removesuffix('+')}{{{rule.least},}}" if rule.regex.endswith("]+") else rule.regex)
        per_rule.append(F.when(F.coalesce(needs, F.lit(False)), _spans(whole(text), rule, number)).otherwise(none))
    return keyed.join(found, key, "left").withColumn(spans, F.array_sort(F.concat(*per_rule))).select(*docs.columns, spans)


def listed(spans: Column, rules: Sequence[Rule], keep: Column | None = None) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rule"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; spans that overlap or touch give one mark. A null text stays null."""
    found = scan(docs, rules)
    spans = found.columns[-1]
    text = F.col("text")

    def replaced(part: Column) -> Column:
        """The text from the first of these spans' places to the end of their last, cut out once."""
        base = F.get(part, F.lit(0))["before"]
        cut = F.substring(text, (base + 1).cast("int"), (F.get(part, F.size(part) - 1)["upto"] - base).cast("int"))

        def piece(held: Column, s: Column) -> Column:
            gap = F.substring(held, (s["before"] - base + 1).cast("int"), (s["start"] - s["before"]).cast("int"))
            return F.when((s["start"] > s["before"]) | ((s["start"] == 0) & (s["before"] == 0)), F.concat(gap, F.lit(mark))).otherwise("")

        return bound(cut, lambda held: F.array_join(F.transform(part, lambda s: piece(held, s)), ""))

    def clean(found: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda c: F.slice(found, c * RUN + 1, RUN))
        rest = F.substring(text, (F.element_at(found, -1)["upto"] + 1).cast("int"), F.lit(2**31 - 1))
        return F.concat(F.array_join(F.transform(parts, replaced), ""), rest)

    # how far the spans up to each reach, so that overlapping ones count once
    upto = prefix(F.transform(F.col(spans), lambda s: s["end"]), F.greatest)
    marked = bound(upto, lambda u: F.zip_with(F.col(spans), F.arrays_zip(u.alias("upto"), F.concat(F.array(F.lit(0).cast("bigint")), u).alias("before")), lambda s, r: F.struct(s["start"].alias("start"), r["before"].alias("before"), r["upto"].alias("upto"))))
    marked = F.slice(marked, 1, F.size(spans))
    return found.withColumn("text", F.when(F.size(spans) > 0, bound(marked, clean)).otherwise(text)).select(*docs.columns)


def _sql() -> str:
    one = []
    for n, r in enumerate(RULES):
        pattern = (r"(?s)(.*?)(" + r.regex + ")").replace("'", "''")
        take = lambda g: f"list_transform(regexp_extract_all(t, '{pattern}', {g}), lambda x: length(x))"  # noqa: B023,E731
        one.append(f"SELECT d, t, {n} AS rule, '{r.kind}' AS kind, {r.least} AS least, {take(1)} AS gap, {take(2)} AS n, {take(2 + r.group)} AS m FROM docs")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({' UNION ALL '.join(one)}),
each AS (SELECT d, rule, kind, least, unnest(gap) AS gap, unnest(n) AS n, unnest(m) AS m, generate_subscripts(n, 1) AS i FROM raw),
placed AS (SELECT d, rule, kind, m >= least AS ok, (sum(gap + n) OVER w)::BIGINT AS e, n FROM each WINDOW w AS (PARTITION BY d, rule ORDER BY i)),
good AS (SELECT d, rule, kind, (e - n)::BIGINT AS s, kind || ':' || (e - n)::BIGINT || ':' || e AS span FROM placed WHERE ok)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, rule) FILTER (rule < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, rule), '') AS spans
FROM docs LEFT JOIN good USING (d) GROUP BY d, doc_id
"""


@catalog.add("op8_secret_scan", _sql())
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = scan(table(spark, sf, "documents").select("doc_id", "text"))
    count = lambda n: F.size(F.filter("spans", lambda s: s["rule"] == n)).cast("bigint")
    base = listed(F.filter("spans", lambda s: s["rule"] < len(BASE)), RULES)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans"), RULES).alias("spans")
    )
