"""Closed-vocabulary tagging and relation extraction from free text, all in native string functions.

Terms are marked longest first: each occurrence becomes a run of one private-use
character as long as the term, so marked text keeps every offset and no later,
shorter term can match inside it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# The default species vocabulary, relations, aliases, verbs and ordered cues.
SPECIES = ["monarch butterfly", "milkweed", "oyamel fir", "blue oak", "hummingbird", "agave", "long-nosed bat",
           "coffee shrub", "stingless bee", "jaguar", "white-tailed deer", "cloud-forest orchid", "leafcutter ant",
           "fungus"]
RELATIONS = ["pollinates", "feeds_on", "parasitizes", "competes_with", "depends_on"]
ALIASES = {"monarch": "monarch butterfly", "monarchs": "monarch butterfly", "bat": "long-nosed bat",
           "bats": "long-nosed bat", "deer": "white-tailed deer", "orchid": "cloud-forest orchid",
           "fir": "oyamel fir", "bee": "stingless bee", "bees": "stingless bee", "ant": "leafcutter ant",
           "ants": "leafcutter ant"}
VERBS = {"pollinates": ["pollinates", "pollinate", "pollinating"],
         "feeds_on": ["feeds on", "feed on", "feeding on", "browsed", "browses"],
         "parasitizes": ["parasitizes", "parasitize", "parasitizing"],
         "competes_with": ["competes with", "compete with", "competing with"],
         "depends_on": ["depends on", "depend on", "depending on"]}
CUES = [(r"\b(larvae|caterpillars?).{0,40}\b(develop|feeding|feed)\b", "depends_on", "SO"),
        (r"\bonly develop on\b", "depends_on", "SO"),
        (r"\bnowhere to lay eggs\b", "depends_on", "OS"),
        (r"\bcanopy shelters\b", "depends_on", "OS"),
        (r"\bclustered\b.{0,20}\bon\b", "depends_on", "SO"),
        (r"\bcultivat", "depends_on", "SO"),
        (r"\bcolony cannot feed\b", "depends_on", "OS"),
        (r"\brely on\b.{0,30}\bfor pollination\b", "pollinates", "OS"),
        (r"\bdepend", "depends_on", "SO"),
        (r"\brely on\b", "depends_on", "SO"),
        (r"\bvisited by\b", "pollinates", "OS"),
        (r"\bpollination by\b", "pollinates", "OS"),
        (r"\bworking\b.{0,20}\bblossom", "pollinates", "SO"),
        (r"\byield\b.{0,30}\btracks how many\b", "pollinates", "OS"),
        (r"\bactivity around\b.{0,20}\bbloom", "pollinates", "SO"),
        (r"\bpollinat", "pollinates", "SO"),
        (r"\bsquabbling over\b", "competes_with", "SO"),
        (r"\bchasing off\b", "competes_with", "SO"),
        (r"\bcompet", "competes_with", "SO"),
        (r"\bdefoliated by\b", "feeds_on", "OS"),
        (r"\bgrazing\b", "feeds_on", "OS"),
        (r"\bpopulation drops where\b", "feeds_on", "OS"),
        (r"\bstripping\b", "feeds_on", "SO"),
        (r"\btook a\b", "feeds_on", "SO"),
        (r"\bbrowse", "feeds_on", "SO"),
        (r"\bfeed(s|ing)?\s+on\b", "feeds_on", "SO"),
        (r"\bparasit", "parasitizes", "SO")]

_PUA = 0xE000
#: Marks around a name in cleaned text.
_OPEN, _CLOSE = chr(_PUA), chr(_PUA + 1)


@dataclass(frozen=True)
class Vocabulary:
    terms: tuple = tuple(SPECIES)
    relations: tuple = tuple(RELATIONS)
    aliases: dict = field(default_factory=lambda: dict(ALIASES))
    verbs: dict = field(default_factory=lambda: dict(VERBS))
    cues: tuple = tuple(CUES)


def _longest_first(words):
    return sorted(words, key=len, reverse=True)


def _mark(lower: Column, plan, boundary: bool) -> Column:
    """Replace each word of ``plan`` = [(word, code)] in turn by a same-length run of its code."""
    for word, code in plan:
        run = chr(_PUA + code) * len(word)
        if boundary:
            lower = F.regexp_replace(lower, r"(?<!\p{L})" + re.escape(word) + r"(?!\p{L})", run)
        else:
            lower = F.replace(lower, F.lit(word), F.lit(run))
    return lower


def _clean(text: str) -> Column:
    """Lower-cased text in which no private-use character survives."""
    return F.regexp_replace(F.lower(text), "[\ue000-\uf8ff]", "\ufffd")


def _plan(voc: Vocabulary, aliases: bool):
    """Marking order, and for every (code, length) the canonical term."""
    words = [(w, w) for w in _longest_first(voc.terms)]
    if aliases:
        words += [(a, voc.aliases[a]) for a in _longest_first(voc.aliases)]
    return [(w, i) for i, (w, _) in enumerate(words)], [c for _, c in words]


def _runs(plan) -> str:
    return "|".join(f"{chr(_PUA + i)}{{{len(w)}}}" for w, i in plan)


def _canonical(ch: Column, names) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.ascii(ch) - _PUA + 1)


def _crossing(words) -> bool:
    """Can one word end inside another with no letter on either side of the seam?"""
    letter = lambda c: c.isalpha()
    for a in words:
        for b in words:
            for k in range(1, min(len(a), len(b))):
                if a[-k:] == b[:k] and not letter(a[-k - 1]) and not letter(b[k]):
                    return True
    return False


def _bounded_pattern(voc: Vocabulary) -> str | None:
    """One pattern for all names and aliases between non-letters, longest first.

    Leftmost matching equals the longest-first scan unless names can cross;
    then there is no such pattern.
    """
    words = _longest_first(list(voc.terms)) + _longest_first(voc.aliases)
    inside = any(re.search(r"(?<![^\W\d_])" + re.escape(t) + r"(?![^\W\d_])", a) for a in voc.aliases for t in voc.terms)
    ends = all(w[:1].isalpha() and w[-1:].isalpha() for w in words)   # otherwise a name can follow another at once
    if _crossing(words) or inside or not ends:   # a name inside an alias is marked before the alias
        return None
    return r"(?<!\p{L})(" + "|".join(re.escape(w) for w in _longest_first(words)) + r")(?!\p{L})"


def _canonical_map(voc: Vocabulary) -> dict[str, str]:
    return {**voc.aliases, **{t: t for t in voc.terms}}


def tag_terms(df: DataFrame, text: str, voc: Vocabulary = Vocabulary(), *, aliases: bool = False,
              out: str = "spans") -> DataFrame:
    """``out`` = array of (pos, term) in reading order, 0-based character offsets.

    Longest term first over the whole text, no overlaps; with ``aliases``
    canonical names come first, then aliases, and letters may not touch a match.
    Marking is native, with aliases in one pass where names cannot cross; only the offsets are read off in an Arrow batch.
    """
    pattern = _bounded_pattern(voc) if aliases else None
    if pattern:
        known, named = _canonical_map(voc), re.compile(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}")

        @F.pandas_udf("array<struct<pos:int,term:string>>")
        def places(marked: pd.Series) -> pd.Series:
            return marked.map(lambda m: None if m is None else [
                {"pos": h.start() - 2 * i, "term": known[h[1]]} for i, h in enumerate(named.finditer(m))])

        return df.withColumn(out, places(F.regexp_replace(_clean(text), pattern, f"{_OPEN}$1{_CLOSE}")))
    plan, names = _plan(voc, aliases)
    runs = re.compile(_runs(plan))

    @F.pandas_udf("array<struct<pos:int,term:string>>")
    def offsets(marked: pd.Series) -> pd.Series:
        return marked.map(lambda m: None if m is None else [
            {"pos": h.start(), "term": names[ord(m[h.start()]) - _PUA]} for h in runs.finditer(m)])

    return df.withColumn(out, offsets(_mark(_clean(text), plan, aliases)))


def _term_sequence(df: DataFrame, text: str, voc: Vocabulary, out: str) -> DataFrame:
    """Canonical names of all mentions (aliases resolved) in reading order, in one pass where names cannot cross."""
    pattern = _bounded_pattern(voc)
    if pattern:
        known = F.create_map(*[F.lit(x) for kv in _canonical_map(voc).items() for x in kv])
        hits = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
        return df.withColumn(out, F.transform(F.array_distinct(hits), lambda h: F.element_at(known, h)))
    plan, names = _plan(voc, True)
    hits = F.regexp_extract_all(_mark(_clean(text), plan, True), F.lit(f"({_runs(plan)})"), F.lit(1))
    return df.withColumn(out, F.transform(hits, lambda h: _canonical(h, names)))


def keyword_triples(df: DataFrame, text: str, voc: Vocabulary = Vocabulary(), out: str = "triples") -> DataFrame:
    """For each verb hit the nearest term before (subject) and after (object), distinct triples.

    Terms, then verbs, are marked and squeezed to one character each.  A verb's
    subject and object are then the characters around its run of verbs, which
    one pattern reads off in linear time.
    """
    words = list(voc.terms)
    verbs = [(v, rel) for rel, vs in voc.verbs.items() for v in vs]
    clash = [(v, w) for v, _ in verbs for w in words if v in w or w in v]
    if clash:
        raise ValueError(f"verbs and terms may not contain each other: {clash[:3]}")
    plan, names = _plan(voc, False)
    base = len(plan)
    order = _longest_first([v for v, _ in verbs])
    rel_of = dict(verbs)
    full = plan + [(v, base + i) for i, v in enumerate(order)]
    hits = F.regexp_extract_all(_mark(_clean(text), full, False), F.lit(f"({_runs(full)})"), F.lit(1))
    d = df.withColumn("_q", F.array_join(F.transform(hits, lambda h: F.substring(h, 1, 1)), ""))
    t_cls = f"[{chr(_PUA)}-{chr(_PUA + base - 1)}]"
    v_cls = f"[{chr(_PUA + base)}-{chr(_PUA + base + len(order) - 1)}]"
    pattern = F.lit(f"({t_cls})({v_cls}+)(?=({t_cls}))")
    part = lambda i: F.regexp_extract_all("_q", pattern, F.lit(i))
    relations = F.array(*[F.lit(rel_of[v]) for v in order])
    seg = F.arrays_zip(part(1).alias("s"), part(2).alias("v"), part(3).alias("o"))
    d = d.withColumn("_z", seg)

    def expand(z):
        rel = F.array_distinct(F.transform(F.split(z["v"], ""), lambda c: F.element_at(relations, F.ascii(c) - _PUA - base + 1)))
        return F.transform(rel, lambda r: F.struct(_canonical(z["s"], names).alias("subject"), r.alias("relation"),
                                                   _canonical(z["o"], names).alias("object")))

    distinct_ends = F.filter("_z", lambda z: z["s"] != z["o"])
    return d.withColumn(out, F.array_distinct(F.flatten(F.transform(distinct_ends, expand)))).drop("_q", "_z")


def cue_triples(df: DataFrame, text: str, voc: Vocabulary = Vocabulary(), out: str = "triple") -> DataFrame:
    """One triple from the first two distinct terms and the first matching cue; NULL if none."""
    d = _term_sequence(df, text, voc, "_t").withColumn("_t", F.slice(F.array_distinct("_t"), 1, 2))
    d = d.withColumn("_a", F.try_element_at("_t", F.lit(1))).withColumn("_b", F.try_element_at("_t", F.lit(2)))
    lower = F.lower(text)
    pick = None
    for pattern, rel, order in voc.cues:
        s, o = ("_a", "_b") if order == "SO" else ("_b", "_a")
        val = F.struct(F.col(s).alias("subject"), F.lit(rel).alias("relation"), F.col(o).alias("object"))
        if rel not in voc.relations:
            val = F.lit(None)
        cond = lower.rlike("(?Ud)" + pattern)
        pick = F.when(cond, val) if pick is None else pick.when(cond, val)
    return d.withColumn(out, F.when(F.col("_b").isNotNull(), pick)).drop("_t", "_a", "_b")


def extract_all(df: DataFrame, id_col: str, text: str, method: str = "cue", voc: Vocabulary = Vocabulary(),
                extractor=None) -> DataFrame:
    """(id, subject, relation, object) rows; ``extractor`` may be any df -> df with those columns."""
    if extractor is not None:
        return extractor(df)
    # inline_outer keeps the optimizer from copying the extraction into a pre-filter
    if method == "cue":
        d = cue_triples(df, text, voc).select(id_col, F.inline_outer(F.array("triple")))
    else:
        d = keyword_triples(df, text, voc).select(id_col, F.inline_outer("triples"))
    return d.filter(F.col("subject").isNotNull())


def invalid_triples(triples: DataFrame, voc: Vocabulary = Vocabulary()) -> DataFrame:
    """Triples outside the closed vocabulary."""
    return triples.filter(~(F.col("subject").isin(*voc.terms) & F.col("object").isin(*voc.terms)
                            & F.col("relation").isin(*voc.relations)))


def distinct_triples(triples: DataFrame) -> DataFrame:
    return triples.select("subject", "relation", "object").distinct()


def interaction_graph(triples: DataFrame):
    """(nodes with in/out degree, typed edges with the number of records)."""
    edges = triples.groupBy("subject", "relation", "object").agg(F.count(F.lit(1)).alias("n"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("subject").alias("species"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                          F.struct(F.col("object").alias("species"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    nodes = ends.groupBy("e.species").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    return nodes, edges


def score_triples(gold: DataFrame, pred: DataFrame, id_col: str, voc: Vocabulary = Vocabulary()) -> DataFrame:
    """Micro-averaged precision, recall and F1 over per-record triple sets (4 decimals)."""
    key = [id_col, "subject", "relation", "object"]
    tagged = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        pred.select(*key, F.lit(0).alias("g"), F.lit(1).alias("p")))
    sets = tagged.groupBy(*key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    valid = (F.col("subject").isin(*voc.terms) & F.col("object").isin(*voc.terms) & F.col("relation").isin(*voc.relations))
    c = sets.agg(F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"),
                 F.count_if((F.col("g") == 0) & (F.col("p") == 1)).alias("fp"),
                 F.count_if((F.col("g") == 1) & (F.col("p") == 0)).alias("fn"),
                 F.count_if((F.col("p") == 1) & ~valid).alias("invalid_triples"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.withColumn("n_predicted", tp + fp).withColumn("_p", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)) \
        .withColumn("_r", F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0))
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0)
    return c.select("tp", "fp", "fn", "n_predicted", F.round("_p", 4).alias("precision"), F.round("_r", 4).alias("recall"),
                    F.round(f1, 4).alias("f1"), "invalid_triples")


#: White space of Python that is none of Unicode's.
_NO_SPACE = dict.fromkeys(range(0x1C, 0x20), "_")


def _n_words(text: str) -> int:
    return len((text.translate(_NO_SPACE) if any(chr(c) in text for c in _NO_SPACE) else text).split())


@cache
def _count_words():
    @F.pandas_udf("int")
    def count(t: pd.Series) -> pd.Series:
        return t.map(lambda s: 0 if s is None else _n_words(s)).astype("int32")

    return count


def word_count(text: Column) -> Column:
    """Words between runs of (Unicode) white space; 0 for empty or NULL text.

    Counted in Arrow batches: patterns over every character, and an array of all words, take several times as long.
    """
    return _count_words()(text)
