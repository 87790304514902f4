"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans: strict ones, and looser ones for what those leave out, secrets among them. Labelers vote on
each: its form (checksums, plausible numbers, hexadecimal of a usual length), a gazetteer (top-level domains, country
codes, issuers' prefixes, reserved networks, names of credentials), the words before it, and the variety of its signs.
Expectation-maximisation estimates from the votes alone how reliable each labeler is and how
likely each pattern of votes is personal data; a logistic span classifier is trained on those
likelihoods. What reaches the driver are counts of vote patterns, a few hundred rows at most.
Spans of the strict patterns always stay; the classifier adds further ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import int_keyed, with_text, wrapped

KINDS = ("email", "ip", "card", "phone")
#: All kinds; of the last there are only looser proposals.
EVERY = (*KINDS, "secret")
VOTES = ("form", "gazetteer", "context", "variety")
#: Rounds of expectation-maximisation, steps of the classifier, its penalty, and the probability that adds a span.
ROUNDS, STEPS, PENALTY, ADDS = 50, 400, 0.01, 0.6
#: Characters before a span that the context labeler reads; matches whose places are summed together.
CONTEXT, CHUNK = 24, 64
#: Characters of a piece of a text that marks are put into.
PIECE = 1024

# What the strict patterns match, written so that Java's engine neither recurses nor retries within a run.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser proposals, which only the classifier can let in.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?(?i:at)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]\x20?(?i:dot)\x20?[\])]\x20?[A-Za-z0-9-]{2,63}|\.[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z+])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z]|[\x20-][0-9])",
    "phone": r"(?<![0-9+(])(?<!\+[0-9][\x20-])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,40}[0-9])[A-Za-z0-9+/_-]{24,128}+={0,2}(?![A-Za-z0-9+/_=-])",
}
#: Cheap tests that a text with a match of the pattern always passes.
MAYBE = {
    ("email", True): "text LIKE '%@%'", ("ip", True): r"text RLIKE '[0-9]\\.[0-9]+\\.[0-9]'", ("card", True): r"text RLIKE '[0-9][\\x20-]?[0-9]'", ("phone", True): "text LIKE '%+%'",
    ("email", False): r"text RLIKE '(?i)[\\[(]\\x20?at\\x20?[\\])]'", ("ip", False): "text RLIKE '[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]'", ("card", False): r"text RLIKE '[0-9](?:[\\x20-]?[0-9]){12}'", ("phone", False): "text RLIKE '[0-9]{3}[.-][0-9]{4}'",
    ("secret", False): "text RLIKE '[A-Za-z0-9+/_-]{24}'",
}
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|dev|app|me|eu|de|fr|es|uk|us|it|nl|pl|ch|at|be|ca|au|jp|cn|in|br|ru|se|no|dk|fi|pt|ie"
NETWORKS = r"^0*(?:0|127|255|22[4-9]|2[34][0-9]|25[0-5])\\."
CREDENTIALS = "token|secret|passw(?:or)?d|pwd|key|bearer|auth|credential|signature"
WORDS = {"secret": "token|secret|password|passwd|pwd|key|bearer|authorization|credential", "email": "mail|contact|write|reach", "ip": "ip|addr|host|server|login", "card": "card|visa|master|amex|pay|account", "phone": "phone|tel|call|fax|mobile|cell"}
AGAINST = "version|isbn|issn|invoice|order|serial|sku|doi"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    doubled = f"transform(sequence(1, length({digits})), i -> cast(substring({digits}, length({digits}) - i + 1, 1) AS int) * (2 - i % 2))"
    return f"aggregate({doubled}, 0, (s, v) -> s + if(v > 9, v - 9, v)) % 10 = 0"


def _fine(kind: str, strict: bool, hit: str) -> str:
    if kind == "ip" and strict:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return f"{hit} RLIKE '^{part}(?:\\\\.{part}){{3}}$'"
    if kind == "card" and strict:
        return f"if(length({_digits(hit)}) BETWEEN 16 AND 19, {_luhn(_digits(hit))}, false)"
    if kind == "phone" and strict:
        return f"length({_digits(hit)}) BETWEEN 8 AND 15"
    return "true"


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with a name for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _found(kind: str, strict: bool) -> str:
    """SQL for the array of (no, kind, strict, start, end, hit, before) of the good matches of a pattern; before is what lies ahead of it, from the match before on.

    Starts follow from the lengths of the matches and of what lies between them: summed by lots of CHUNK matches first,
    then within each lot, as an array that grows match by match would be copied each time.
    """
    pattern = _sql((STRICT if strict else LOOSE)[kind])
    empty = "cast(array() AS array<struct<no:int,kind:string,strict:boolean,start:int,end:int,hit:string,before:string>>)"
    hits = f"regexp_extract_all(text, {pattern}, 0)"
    steps = _let("hits", hits, f"zip_with(hits, slice(split(text, {pattern}, -1), 1, size(hits)), (h, gap) -> named_struct('h', h, 'gap', length(gap), 'size', length(h), 'before', lower(substring(gap, -{CONTEXT}))))")
    lots = f"transform(sequence(0, (size(m) - 1) div {CHUNK}), c -> slice(m, c * {CHUNK} + 1, {CHUNK}))"
    sums = "transform(lots, l -> aggregate(l, 0, (t, x) -> t + x.gap + x.size))"
    starts = f"aggregate({sums}, named_struct('at', 0, 'out', cast(array() AS array<int>)), (acc, v) -> named_struct('at', acc.at + v, 'out', array_append(acc.out, acc.at)), acc -> acc.out)"
    span = f"named_struct('no', {EVERY.index(kind)}, 'kind', '{kind}', 'strict', {str(strict).lower()}, 'start', acc.at + x.gap, 'end', acc.at + x.gap + x.size, 'hit', x.h, 'before', x.before)"
    step = f"named_struct('at', acc.at + x.gap + x.size, 'out', if({_fine(kind, strict, 'x.h')}, array_append(acc.out, {span}), acc.out))"
    within = f"zip_with(lots, {starts}, (l, at) -> aggregate(l, named_struct('at', at, 'out', {empty}), (acc, x) -> {step}, acc -> acc.out))"
    spans = _let("m", steps, f"if(size(m) = 0, {empty}, {_let('lots', lots, f'flatten({within})')})")
    return f"if({MAYBE[kind, strict]}, {spans}, {empty})"


def proposals(docs: DataFrame) -> DataFrame:
    """docs with base and loose spans; loose ones that touch a base span are left out."""
    base = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("base", F.expr(f"concat({', '.join(_found(k, True) for k in KINDS)})"))
    loose = base.withColumn("loose", F.expr(f"concat({', '.join(_found(k, False) for k in EVERY)})"))
    return loose.withColumn("loose", F.expr("filter(loose, l -> NOT exists(base, b -> b.start < l.end AND l.start < b.end))"))


def votes(span: str) -> str:
    """SQL for the labelers' votes on a span: 1 for, -1 against, 0 none."""
    hit, digits = f"{span}.hit", _digits(f"{span}.hit")
    before = f"{span}.before"
    low = f"lower({hit})"
    form = (
        f"CASE {span}.kind WHEN 'email' THEN if({low} RLIKE '^[^@]*[a-z]', 1, -1) WHEN 'ip' THEN if({span}.strict AND {hit} RLIKE '(?:^|\\\\.)0[0-9]', -1, 1)"
        f" WHEN 'card' THEN if(length({digits}) >= 13 AND {_luhn(digits)}, 1, -1) WHEN 'phone' THEN if({span}.strict, 1, 0)"
        f" ELSE if({hit} RLIKE '^(?:[0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}})$', 1, if({hit} RLIKE '[/_-].*[/_-]', -1, 0)) END"
    )
    gazetteer = (
        f"CASE {span}.kind WHEN 'email' THEN if({low} RLIKE '[.)\\\\] ](?:{DOMAINS})$', 1, -1)"
        f" WHEN 'ip' THEN if({hit} RLIKE '{NETWORKS}', -1, 1) WHEN 'card' THEN if({digits} RLIKE '^(?:4|5[1-5]|2[2-7]|3[47]|6)', 1, -1)"
        f" WHEN 'phone' THEN if({digits} RLIKE '^(?:1|7|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])', 1, 0)"
        f" ELSE if({before} RLIKE '(?:{CREDENTIALS})[a-z_]*[\\\\x20]?[=:]?[\\\\x20]?[^a-z0-9]?$', 1, 0) END"
    )
    told = " ".join(f"WHEN {span}.kind = '{k}' AND {before} RLIKE '(?:^|[^a-z])(?:{w})' THEN 1" for k, w in WORDS.items())
    context = f"CASE WHEN {before} RLIKE '(?:^|[^a-z])(?:{AGAINST})[^a-z]*$' THEN -1 {told} ELSE 0 END"
    variety = f"CASE WHEN {span}.kind = 'email' THEN 0 WHEN {span}.kind = 'secret' THEN if(size(array_distinct(split({hit}, ''))) >= 10, 1, -1) WHEN {digits} RLIKE '^([0-9])\\\\1+$' THEN -1 ELSE 1 END"
    return f"named_struct('form', {form}, 'gazetteer', {gazetteer}, 'context', {context}, 'variety', {variety})"


Pattern = tuple[str, int, int, int, int]


def reliabilities(counts: dict[Pattern, int]) -> dict[Pattern, float]:
    """How likely each pattern (kind, votes) is personal data, by expectation-maximisation with smoothed vote tables for either class."""
    belief = {p: min(0.95, max(0.05, 0.5 + 0.2 * sum(p[1:]))) for p in counts}
    for _ in range(ROUNDS):
        total = sum(counts.values())
        share = (sum(n * belief[p] for p, n in counts.items()) + 1) / (total + 2)
        tables = []
        for labeler in range(len(VOTES)):
            table: dict[tuple[int, int], float] = {}
            for truth in (0, 1):
                prior = {1: 2.0 if truth else 1.0, 0: 1.0, -1: 1.0 if truth else 2.0}
                mass = {v: prior[v] + sum(n * (belief[p] if truth else 1 - belief[p]) for p, n in counts.items() if p[1 + labeler] == v) for v in (1, 0, -1)}
                table |= {(truth, v): m / sum(mass.values()) for v, m in mass.items()}
            tables.append(table)
        for p in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(t[1, v] / t[0, v]) for t, v in zip(tables, p[1:], strict=True))
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def features(pattern: Pattern) -> list[str]:
    return ["bias", pattern[0], *(f"{name}={v}" for name, v in zip(VOTES, pattern[1:], strict=True) if v)]


def train(counts: dict[Pattern, int], belief: dict[Pattern, float]) -> dict[str, float]:
    """Weights of a logistic classifier of spans, by gradient steps on the patterns with their likelihoods as soft labels."""
    weights = {f: 0.0 for p in counts for f in features(p)}
    total = max(1, sum(counts.values()))
    for _ in range(STEPS):
        slope = {f: -PENALTY * w for f, w in weights.items()}
        for p, n in counts.items():
            own = features(p)
            error = belief[p] - 1 / (1 + math.exp(-sum(weights[f] for f in own)))
            for f in own:
                slope[f] += n / total * error
        for f, s in slope.items():
            weights[f] += 2.0 * s
    return weights


def fit(docs: DataFrame) -> dict[str, float]:
    """The span classifier, from the votes on every span proposed in docs (doc_id, text)."""
    cast = F.expr(f"transform(concat(base, loose), s -> named_struct('kind', s.kind, 'v', {votes('s')}))")
    told = proposals(docs.select("text")).select(F.explode(cast).alias("s")).select("s.*").groupBy("kind", "v").count().collect()  # of 5 * 81 patterns at most
    counts = {(r["kind"], *(r["v"][x] for x in VOTES)): r["count"] for r in told}
    return train(counts, reliabilities(counts))


def _probability(weights: dict[str, float]) -> str:
    def of(condition: str, name: str) -> str:
        return f"if({condition}, {weights.get(name, 0.0)!r}D, 0D)"

    terms = [of("true", "bias"), *(of(f"l.kind = '{k}'", k) for k in EVERY), *(of(f"v.{name} = {vote}", f"{name}={vote}") for name in VOTES for vote in (1, -1))]
    return f"1 / (1 + exp(-({' + '.join(terms)})))"


def spans(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """docs with ``base`` and ``spans`` (base and added ones), each by kind and then start."""
    ordered = "array_sort({0}, (x, y) -> CASE WHEN x.no <> y.no THEN x.no - y.no ELSE x.start - y.start END)"
    lets_in = F.expr(f"filter(transform(loose, l -> struct(l, {votes('l')} AS v)), c -> {_probability(weights).replace('l.kind', 'c.l.kind').replace('v.', 'c.v.')} >= {ADDS})")
    added = proposals(docs).withColumn("added", F.transform(lets_in, lambda c: c["l"])).drop("loose")
    return added.withColumns({"base": F.expr(ordered.format("base")), "spans": F.expr(ordered.format("concat(base, added)"))}).drop("added")


def _told(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, s -> concat(s.kind, ':', cast(s.start AS string), ':', cast(s.end AS string))), ',')")


def pii_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs (doc_id, text).

    Counts and digest are of the base spans, ``spans`` has all, as kind:start:end in code points with the end exclusive,
    n_added how many are not base. Null and empty texts have none. Each row stands for itself, also with a null or
    repeated doc_id; texts of any length are read whole. An empty table gives no rows; further columns are ignored.
    """
    docs = int_keyed(docs, "doc_id", "text")
    found = spans(docs, fit(docs))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_told("base"), 256).alias("base_sha256"), _told("spans").alias("spans"), added)


def _cut(text: str, spans: str, mark: str) -> str:
    """SQL for the text with a mark (SQL of k.kind) in place of each of the spans, which are in order; a span that begins in one already marked is left out.

    The text is first cut into lots of PIECE characters, as a place in a string is found from its head.
    """
    kept = "named_struct('at', s.end, 'out', array_append(acc.out, named_struct('a', acc.at, 'b', s.start, 'kind', s.kind)))"
    none = "cast(array() AS array<struct<a:int,b:int,kind:string>>)"
    lots = f"transform(if(size({spans}) = 0, array(), sequence(0, (size({spans}) - 1) div {CHUNK})), c -> slice({spans}, c * {CHUNK} + 1, {CHUNK}))"
    lot = f"aggregate(lot, named_struct('at', whole.at, 'out', {none}), (acc, s) -> if(s.start < acc.at, acc, {kept}))"
    step = _let("r", lot, "named_struct('at', r.at, 'out', array_append(whole.out, r.out))")
    run = f"aggregate({lots}, named_struct('at', 0, 'out', cast(array() AS array<array<struct<a:int,b:int,kind:string>>>)), (whole, lot) -> {step})"

    def piece(a: str, b: str) -> str:
        inner = f"concat(substring(bl[{a} div {PIECE}], {a} % {PIECE} + 1), array_join(slice(bl, {a} div {PIECE} + 2, {b} div {PIECE} - {a} div {PIECE} - 1), ''), if({b} % {PIECE} = 0, '', substring(bl[{b} div {PIECE}], 1, {b} % {PIECE})))"
        return f"if({b} <= {a}, '', if({a} div {PIECE} = {b} div {PIECE}, substring(bl[{a} div {PIECE}], {a} % {PIECE} + 1, {b} - {a}), {inner}))"

    told = f"concat(array_join(transform(flatten(cut.out), k -> concat({piece('k.a', 'k.b')}, {mark})), ''), {piece('cut.at', 'n')})"
    return _let("bl", f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)", _let("n", f"length({text})", _let("cut", run, told)))


def redact(spark: SparkSession, docs: DataFrame, marks: Iterable[tuple[str, str]] = tuple((k, f"[{k.upper()}]") for k in EVERY)) -> DataFrame:
    """docs with a mark in place of each span; of overlapping spans the first by start, then the longest.

    Null texts stay null, and texts without spans stay as they are; n_chars follows. Each row stands for itself, also with
    a null or repeated doc_id, and keeps its other columns, whatever their names.
    """
    mark = "CASE k.kind " + " ".join(f"WHEN '{k}' THEN {_sql(m)}" for k, m in dict(marks).items()) + " ELSE '' END"
    found = spans(wrapped(docs), fit(docs)).withColumn("spans", F.expr("array_sort(spans, (x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start ELSE y.end - x.end END)"))
    return with_text(found.withColumn("text", F.expr(f"if(size(spans) = 0, row.text, {_cut('text', 'spans', mark)})")), docs)
