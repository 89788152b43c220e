"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from the strict patterns and from looser ones.  Labelers
(pattern check, gazetteer, context words, boundaries) vote on each candidate;
expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is; its posteriors train a naive-Bayes span classifier.  A span of
the strict patterns always stays; others are added where both agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import store, table

KINDS = ("email", "ip", "card", "phone")
TAGS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")

# Strict patterns, written so that a long run is scanned once and no loop recurses: a match starts where
# its run of characters starts (or at the end of the match before it) and loops never give back.
STRICT = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{]at[)\]}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]{1,63}+)++",
    r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    None,
    r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])",
)
#: A text without this cannot hold the pattern.
NEEDS = (r"@", r"[0-9]\.[0-9]", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", r"\+[0-9]")
NEEDS_LOOSE = (r"at[)\]}]", r"[0-9A-Fa-f]:[0-9A-Fa-f]", None, r"[0-9]{3}[-. ][0-9]{4}")

# Gazetteers and context words (fixed values).
DOMAIN_ENDS = "com org net edu gov io info de fr es it nl eu uk us ca au ch at be pl pt se br mx jp cn in ru".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0457-9]|6)"
CALLING = r"^\+?(?:1[2-9]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|[2-9][0-9]{9})"
CUES = (
    r"(?i)\b(?:e-?mails?|mail|mailto|contact|correo|courriel|kontakt)\b[^\n]{0,24}$",
    r"(?i)\b(?:ip|ipv4|ipv6|host|server|address|addr)\b[^\n]{0,24}$",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b[^\n]{0,24}$",
    r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\b[^\n]{0,24}$",
)
LABELERS = ("check", "gazetteer", "context", "boundary")
#: Rounds of expectation-maximisation, pseudo-observations behind each labeler, and their split over (agree, abstain, against).
ROUNDS, BELIEF, SPLIT = 10, 20.0, (0.6, 0.3, 0.1)


CANDIDATES = "array<struct<kind:int,start:int,end:int,strict:boolean,votes:array<int>,features:array<string>>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(_digits(v)), i, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(_digits(v))), F.lit(0), add) % 10 == 0


def _octets(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))


def _valid(kind: int, v: Column) -> Column:
    n = F.length(_digits(v))
    return (F.lit(True), _octets(v), _luhn(v), (n >= 10) & (n <= 15))[kind]


def _char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^[A-Za-z0-9_]"), 3).otherwise(2)


def _candidate(kind: int, strict: bool, start: Column, v: Column, before: Column, after: Column) -> Column:
    """The struct of one candidate: place, whether it is a strict span, the votes and the features."""
    ok = _valid(kind, v) if strict else F.lit(False)
    check = F.when(ok, 1).otherwise(-1) if strict else F.lit(0)
    d = _digits(v)
    last = F.lower(F.regexp_extract(v, r"([A-Za-z0-9-]+)$", 1))
    gazetteer = (F.when(last.isin(DOMAIN_ENDS), 1).otherwise(-1),
                 F.when(v.rlike(r"^(?:0|255)\."), -1).otherwise(1),
                 F.when(d.rlike(ISSUERS), 1).otherwise(-1),
                 F.when((F.substring(v, 1, 1) == "+") & v.rlike(CALLING), 1).when(d.rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1))[kind]
    near = F.right(before, F.lit(40))
    context = F.when(near.rlike(CUES[kind]), 1).otherwise(0)
    left, right = _char_class(F.right(before, F.lit(1))), _char_class(F.left(after, F.lit(1)))
    boundary = F.when((left == 3) | (right == 3) | after.rlike(r"^[.-][0-9]"), -1).when((left <= 1) & (right <= 2), 1).otherwise(0)
    shape = F.regexp_replace(F.regexp_replace(F.left(v, F.lit(24)), "[0-9]+", "9"), "[A-Za-z]+", "a")
    return F.struct(
        F.lit(kind).alias("kind"), start.cast("int").alias("start"), (start + F.length(v)).cast("int").alias("end"), ok.alias("strict"),
        F.array(check.cast("int"), gazetteer.cast("int"), context.cast("int"), boundary.cast("int")).alias("votes"),
        F.array(left.cast("string"), right.cast("string"), F.least(F.length(v), F.lit(40)).cast("string"), F.length(shape).cast("string")).alias("features"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def running(lengths: Column) -> Column:
    """Running sums of an array of whole numbers, over stretches of about the square root of its size."""
    def stretches(a: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(a))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(a) - 1, step), lambda i: F.slice(a, i + 1, step))

    def sums(parts: Column, totals: Column) -> Column:
        return F.flatten(F.transform(parts, lambda c, j: _let(
            _total(F.slice(totals, 1, j)), lambda before: F.transform(c, lambda _, i: before + _total(F.slice(c, 1, i + 1))))))

    return F.when(F.size(lengths) > 0, _let(stretches(lengths), lambda parts: _let(F.transform(parts, _total), lambda t: sums(parts, t))))


def _places(kind: int, strict: bool, found: str, parts: str) -> Column:
    """Candidates of one pattern from its matches and the pieces of text between them."""
    k = F.size(found)
    ends = running(F.zip_with(found, F.slice(parts, 1, k), lambda v, b: F.length(v) + F.length(b)))
    rows = F.arrays_zip(F.col(found).alias("v"), F.slice(parts, 1, k).alias("b"), F.slice(parts, 2, k).alias("a"), ends.alias("e"))
    each = F.transform(rows, lambda r: _candidate(kind, strict, r["e"] - F.length(r["v"]), r["v"], r["b"], r["a"]))
    return F.when(k > 0, each.cast(CANDIDATES)).otherwise(F.array().cast(CANDIDATES))


def candidates(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` columns and ``found``, the array of candidates of each row."""
    t = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_t"))
    names = [c for c in t.columns if c != "_t"]
    todo = [(k, True, STRICT[k], NEEDS[k]) for k in range(4)] + [(k, False, LOOSE[k], NEEDS_LOOSE[k]) for k in range(4) if LOOSE[k]]
    cols = {}
    for j, (_, _, pattern, need) in enumerate(todo):
        here = F.col("_t").rlike(need)
        cols[f"_m{j}"] = F.when(here, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        cols[f"_s{j}"] = F.when(here, F.split("_t", pattern, -1)).otherwise(F.array().cast("array<string>"))
    t = t.withColumns(cols)
    return t.select(*names, F.concat(*[_places(k, strict, f"_m{j}", f"_s{j}") for j, (k, strict, _, _) in enumerate(todo)]).alias("found"))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _map(d: dict, key=str) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(key(k)), F.lit(float(v)))])


def _vote_score(prior: dict, ratio: dict) -> Column:
    score = F.element_at(_map(prior, int), F.col("kind"))
    for j in range(len(LABELERS)):
        score = score + F.element_at(_map(ratio, int), F.col("kind") * 12 + j * 3 + F.element_at("votes", j + 1) + 1)
    return score


def reliabilities(found: DataFrame) -> tuple[dict, dict]:
    """Prior log-odds by kind and log ratio by (kind, labeler, vote).

    The vote patterns are counted once (at most 4 x 3^4 rows); each round is one
    aggregation of that table to at most 48 sums.
    """
    patterns = store(found.select(F.explode("found").alias("c")).groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes")).agg(
        F.count(F.lit(1)).alias("n")), "pii-patterns")
    prior = {k: 0.0 for k in range(4)}
    ratio = {k * 12 + j * 3 + v + 1: math.log(SPLIT[1 - v] / SPLIT[1 + v]) for k in range(4) for j in range(len(LABELERS)) for v in (-1, 0, 1)}
    for _ in range(ROUNDS):
        p = 1 / (1 + F.exp(-_vote_score(prior, ratio)))
        sums = patterns.withColumn("p", p).select("kind", "n", "p", F.posexplode("votes").alias("j", "v")).groupBy("kind", "j", "v").agg(
            F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
        yes, no = {}, {}
        for r in sums:
            yes[r["kind"], r["j"], r["v"]], no[r["kind"], r["j"], r["v"]] = r["yes"], r["no"]
        for k in range(4):
            a = sum(yes.get((k, 0, v), 0.0) for v in (-1, 0, 1)) + 1
            b = sum(no.get((k, 0, v), 0.0) for v in (-1, 0, 1)) + 1
            prior[k] = max(-4.0, min(4.0, math.log(a / b)))
            for j in range(len(LABELERS)):
                for v in (-1, 0, 1):
                    good = (yes.get((k, j, v), 0.0) + BELIEF * SPLIT[1 - v]) / (a - 1 + BELIEF)
                    bad = (no.get((k, j, v), 0.0) + BELIEF * SPLIT[1 + v]) / (b - 1 + BELIEF)
                    ratio[k * 12 + j * 3 + v + 1] = math.log(good / bad)
    return prior, ratio


def classifier(found: DataFrame, prior: dict, ratio: dict) -> dict[str, float]:
    """Log ratio by "kind:feature:value", from posteriors as soft labels (at most 4 kinds x 4 features x 41 values)."""
    p = 1 / (1 + F.exp(-_vote_score(prior, ratio)))
    rows = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features").withColumn("p", p)
    sums = rows.select("kind", "p", F.posexplode("features").alias("j", "v")).groupBy("kind", "j", "v").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    all_yes, all_no = {}, {}
    for r in sums:
        all_yes[r["kind"], r["j"]] = all_yes.get((r["kind"], r["j"]), 0.0) + r["yes"]
        all_no[r["kind"], r["j"]] = all_no.get((r["kind"], r["j"]), 0.0) + r["no"]
    return {f"{r['kind']}:{r['j']}:{r['v']}": math.log((r["yes"] + 1) / (all_yes[r["kind"], r["j"]] + 40) / ((r["no"] + 1) / (all_no[r["kind"], r["j"]] + 40)))
            for r in sums}


def choose(found: DataFrame, prior: dict, ratio: dict, weights: dict[str, float]) -> DataFrame:
    """``found`` with ``spans``: strict spans, and candidates that votes and classifier accept and no strict span touches."""
    by_vote, by_prior = _map(ratio, int), _map(prior, int)
    by_feature = _map(weights) if weights else F.create_map(F.lit(""), F.lit(0.0))

    def accepted(c: Column) -> Column:
        votes = F.element_at(by_prior, c["kind"])
        for j in range(len(LABELERS)):
            votes = votes + F.element_at(by_vote, c["kind"] * 12 + j * 3 + F.element_at(c["votes"], j + 1) + 1)
        features = F.element_at(by_prior, c["kind"])
        for j in range(4):
            features = features + F.coalesce(F.element_at(by_feature, F.concat_ws(":", c["kind"].cast("string"), F.lit(str(j)), F.element_at(c["features"], j + 1))), F.lit(0.0))
        return ~c["strict"] & (F.element_at(c["votes"], 1) >= 0) & (votes > 0) & (votes + features > 0)

    split = found.withColumn("_base", F.filter("found", lambda c: c["strict"])).withColumn("_more", F.filter("found", accepted))
    free = F.filter("_more", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    place = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    return split.withColumn("base", F.sort_array(F.transform("_base", place))).withColumn(
        "spans", F.sort_array(F.concat(F.transform("_base", place), F.transform(free, place)))).drop("_base", "_more", "found")


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))))


def _only(kind: int):
    return lambda s: F.when(s["kind"] == kind, s["start"])


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans per row; null text is empty and has none.  Texts are scanned once."""
    found = store(candidates(docs, F.col(f"`{text}`"), [F.col(f"`{doc_id}`").alias("doc_id")]), "pii")
    prior, ratio = reliabilities(found)
    out = choose(found, prior, ratio, classifier(found, prior, ratio))
    counts = [F.size(F.array_compact(F.transform("base", _only(k)))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span replaced by the tag of its kind (overlapping spans by one tag) and ``n_chars`` brought up to date."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = store(candidates(docs, F.col(f"`{text}`"), [row]), "pii")
    prior, ratio = reliabilities(found.select("found"))
    out = choose(found, prior, ratio, classifier(found.select("found"), prior, ratio))
    t = F.col("row")[text]

    def step(acc: Column, s: Column) -> Column:
        tag = F.element_at(F.array(*map(F.lit, TAGS)), s["kind"] + 1)
        piece = F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), tag)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    out = out.withColumn("_done", F.when(F.size("spans") > 0, folded))
    clean = F.when(F.col("_done").isNull(), t).otherwise(F.concat(F.col("_done.out"), F.substring(t, F.col("_done.at") + 1, F.length(t))))
    out = out.select("row", clean.alias("_clean"))
    fields = []
    for c in docs.columns:
        f = F.col("row")[c]
        if c == text:
            f = F.col("_clean")
        elif c == n_chars:
            kind = docs.schema[c].dataType
            f = F.when(F.col("_clean").isNull(), f).otherwise(F.length("_clean").cast(kind))
        fields.append(f.alias(c))
    return out.select(*fields)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents"))
