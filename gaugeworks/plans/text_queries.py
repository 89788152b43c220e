"""Text extraction, gates, ledger and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, ledger, profile, text
from ..session import shared_dir, store

from .base import CTE, query, read, with_

# A stand-in vocabulary of frequent words; the library default is the species vocabulary.
VOC = text.Vocabulary(
    terms=("the", "that", "this", "with", "from", "der", "und", "des", "que", "les"),
    relations=("pollinates", "feeds_on", "competes_with", "depends_on"),
    aliases={"dem": "der", "den": "der", "el": "que", "la": "les"},
    verbs={"pollinates": ["was"], "feeds_on": ["are", "been"], "depends_on": ["for"], "competes_with": ["pero", "aber"]},
    cues=((r"(^|[^\p{L}\p{N}_])for the([^\p{L}\p{N}_]|$)", "depends_on", "SO"),
          (r"(^|[^\p{L}\p{N}_])by.{0,30}[^\p{L}\p{N}_]the([^\p{L}\p{N}_]|$)", "pollinates", "OS"),
          (r"(^|[^\p{L}\p{N}_])und (der|die)([^\p{L}\p{N}_]|$)", "competes_with", "SO"),
          (r"(^|[^\p{L}\p{N}_])que la([^\p{L}\p{N}_]|$)", "feeds_on", "OS"),
          (r"(^|[^\p{L}\p{N}_])was", "feeds_on", "SO"),
          (r"(^|[^\p{L}\p{N}_])(et|y) ", "unlisted", "SO")))

_LEN = lambda ws: sorted(ws, key=len, reverse=True)
_TERMS = _LEN(VOC.terms)
_VERBS = _LEN([v for vs in VOC.verbs.values() for v in vs])
_ALIAS = _LEN(VOC.aliases)
_ch = lambda i: chr(0xE000 + i)
_CLEAN = "regexp_replace(lower(text), '[\\x{E000}-\\x{F8FF}]', chr(65533), 'g')"


def _replace_sql(expr: str, words, base: int = 0) -> str:
    """Same-length marks by nested replace()."""
    for i, w in enumerate(words):
        expr = f"replace({expr}, '{w}', repeat('{_ch(base + i)}', {len(w)}))"
    return expr


def _bounded_sql(expr: str, words, base: int = 0) -> str:
    """Marks with letter boundaries; applied twice because the separators are consumed."""
    for i, w in enumerate(words):
        for _ in range(2):
            expr = f"regexp_replace({expr}, '(^|[^\\p{{L}}]){w}([^\\p{{L}}]|$)', '\\1{_ch(base + i) * len(w)}\\2', 'g')"
    return expr


def _runs(words, base=0):
    return "|".join(f"{_ch(base + i)}{{{len(w)}}}" for i, w in enumerate(words))


def _name_sql(ch: str, names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][ord({ch}) - {0xE000 - 1}]"


CTE["marked"] = f"marked AS MATERIALIZED (SELECT doc_id, {_replace_sql(_CLEAN, _TERMS)} AS m FROM documents)"
_ALL_WORDS = _TERMS + _ALIAS
_ALL_NAMES = _TERMS + [VOC.aliases[a] for a in _ALIAS]
CTE["amarked"] = f"amarked AS MATERIALIZED (SELECT doc_id, lower(text) AS low, {_bounded_sql(_CLEAN, _ALL_WORDS)} AS m FROM documents)"


def docs(spark, d):
    """Ids and texts dealt out by id: the patterns below take far longer over a text than its way through a
    shuffle, and a file of one row group, however large, would be one task."""
    return read(spark, d, "documents").select("doc_id", "text").repartition("doc_id")


def _spans_sql(cte, words, names):
    return with_(cte, f"""SELECT doc_id, pos, term FROM (SELECT doc_id, {_name_sql('h', names)} AS term,
      CAST(sum(length(gap)) OVER w + coalesce(sum(length(h)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS pos FROM (
      SELECT doc_id, unnest(hits) AS h, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM (
        SELECT doc_id, regexp_extract_all(m, '{_runs(words)}') AS hits, string_split_regex(m, '{_runs(words)}') AS gaps FROM {cte}))
      WINDOW w AS (PARTITION BY doc_id ORDER BY i))""")


@query("l1_term_spans", _spans_sql("marked", _TERMS, _TERMS))
def _(spark, d):
    t = text.tag_terms(docs(spark, d), "text", VOC)
    return t.select("doc_id", F.inline_outer("spans")).filter("pos is not null")


@query("l2_alias_spans", _spans_sql("amarked", _ALL_WORDS, _ALL_NAMES))
def _(spark, d):
    t = text.tag_terms(docs(spark, d), "text", VOC, aliases=True)
    return t.select("doc_id", F.inline_outer("spans")).filter("pos is not null")


_REL_OF = {v: r for r, vs in VOC.verbs.items() for v in vs}
CTE["kw"] = f"""kwm AS MATERIALIZED (SELECT doc_id, {_replace_sql('m', _VERBS, len(_TERMS))} AS m FROM marked),
kwt AS (SELECT doc_id, unnest(hits) AS h, unnest(range(len(hits))) AS i FROM (SELECT doc_id, regexp_extract_all(m, '{_runs(_TERMS + _VERBS)}') AS hits FROM kwm)),
kww AS (SELECT doc_id, h, i, last_value(CASE WHEN ord(h) < {0xE000 + len(_TERMS)} THEN h END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s,
  first_value(CASE WHEN ord(h) < {0xE000 + len(_TERMS)} THEN h END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS o FROM kwt),
kw AS (SELECT DISTINCT doc_id, {_name_sql('s', _TERMS)} AS subject, {_name_sql('h', [''] * len(_TERMS) + [_REL_OF[v] for v in _VERBS])} AS relation, {_name_sql('o', _TERMS)} AS object
  FROM kww WHERE ord(h) >= {0xE000 + len(_TERMS)} AND s IS NOT NULL AND o IS NOT NULL AND substr(s, 1, 1) <> substr(o, 1, 1))"""


@query("l3_keyword_triples", with_("marked kw", "SELECT * FROM kw"))
def _(spark, d):
    return text.extract_all(docs(spark, d), "doc_id", "text", "keyword", VOC)


_CUE_CASE = " ".join(
    f"WHEN regexp_matches(low, '{p}') THEN " + (f"[{'f, g' if o == 'SO' else 'g, f'}, '{r}']" if r in VOC.relations else "NULL") for p, r, o in VOC.cues)
CTE["cue"] = f"""ct AS (SELECT doc_id, low, list_transform(regexp_extract_all(m, '{_runs(_ALL_WORDS)}'), lambda h: {_name_sql('h', _ALL_NAMES)}) AS t FROM amarked),
cf AS (SELECT doc_id, low, t[1] AS f, list_filter(t, lambda x: x <> t[1])[1] AS g FROM ct),
cr AS (SELECT doc_id, CASE {_CUE_CASE} END AS r FROM cf WHERE g IS NOT NULL),
cue AS (SELECT doc_id, r[1] AS subject, r[3] AS relation, r[2] AS object FROM cr WHERE r IS NOT NULL)"""


def cue_rows(spark, d):
    return text.extract_all(docs(spark, d), "doc_id", "text", "cue", VOC)


@query("l4_cue_triples", with_("amarked cue", "SELECT * FROM cue"))
def _(spark, d):
    return cue_rows(spark, d)


@query("l5_batch_extraction", with_("marked amarked kw cue", "SELECT method, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT 'keyword' AS method, doc_id FROM kw UNION ALL SELECT 'cue', doc_id FROM cue) GROUP BY 1"))
def _(spark, d):
    a = text.extract_all(docs(spark, d), "doc_id", "text", "keyword", VOC).withColumn("method", F.lit("keyword"))
    b = cue_rows(spark, d).withColumn("method", F.lit("cue"))
    return a.unionByName(b).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("l6_invalid_triples", with_("marked kw", "SELECT doc_id, subject, relation, object FROM kw WHERE NOT (subject IN ('the', 'that', 'with') AND object IN ('the', 'that', 'with') AND relation IN ('depends_on'))"))
def _(spark, d):
    small = text.Vocabulary(terms=("the", "that", "with"), relations=("depends_on",))
    return text.invalid_triples(text.extract_all(docs(spark, d), "doc_id", "text", "keyword", VOC), small)


@query("u1_distinct_triples", with_("amarked cue", "SELECT DISTINCT subject, relation, object FROM cue"))
def _(spark, d):
    return text.distinct_triples(cue_rows(spark, d))


@query("l7_graph_edges", with_("amarked cue", "SELECT subject, relation, object, count(*) AS n FROM cue GROUP BY 1, 2, 3"))
def _(spark, d):
    return text.interaction_graph(cue_rows(spark, d))[1]


@query("l7_graph_nodes", with_("amarked cue", """SELECT species, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
    SELECT subject AS species, 1 AS o, 0 AS i FROM (SELECT DISTINCT subject, relation, object FROM cue) UNION ALL
    SELECT object, 0, 1 FROM (SELECT DISTINCT subject, relation, object FROM cue)) GROUP BY 1"""))
def _(spark, d):
    return text.interaction_graph(cue_rows(spark, d))[0]


_SCORE = """SELECT tp, fp, fn, tp + fp AS n_predicted, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1,
    CAST(0 AS BIGINT) AS invalid_triples FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (
    SELECT (SELECT count(*) FROM (SELECT * FROM {g} INTERSECT SELECT * FROM {p})) AS tp, (SELECT count(*) FROM (SELECT * FROM {p} EXCEPT SELECT * FROM {g})) AS fp,
      (SELECT count(*) FROM (SELECT * FROM {g} EXCEPT SELECT * FROM {p})) AS fn))"""


@query("g19_triple_scores", with_("marked amarked kw cue", _SCORE.format(g="cue", p="kw")))
def _(spark, d):
    x = docs(spark, d)
    return text.score_triples(text.extract_all(x, "doc_id", "text", "cue", VOC), text.extract_all(x, "doc_id", "text", "keyword", VOC), "doc_id", VOC)


@query("u2_triple_set_operations", with_("marked amarked kw cue", """SELECT 'both' AS part, * FROM (SELECT * FROM cue INTERSECT SELECT * FROM kw) UNION ALL
    SELECT 'gold_only', * FROM (SELECT * FROM cue EXCEPT SELECT * FROM kw)"""))
def _(spark, d):
    x = docs(spark, d)
    g = text.extract_all(x, "doc_id", "text", "cue", VOC)
    p = text.extract_all(x, "doc_id", "text", "keyword", VOC)
    on = ["doc_id", "subject", "relation", "object"]
    found = g.join(p.distinct().withColumn("_p", F.lit(1)), on, "left")   # each text is read once a method
    return found.withColumn("part", F.when(F.col("_p") == 1, "both").otherwise("gold_only")).drop("_p")


@query("c13_extraction_comparison", with_("marked amarked kw cue", f"SELECT 'cue' AS method, * FROM ({_SCORE.format(g='kw', p='cue')}) UNION ALL SELECT 'keyword', * FROM ({_SCORE.format(g='cue', p='kw')})"))
def _(spark, d):
    x = docs(spark, d)
    a, b = (store(text.extract_all(x, "doc_id", "text", m, VOC), "triples") for m in ("cue", "keyword"))   # read twice
    return text.score_triples(b, a, "doc_id", VOC).withColumn("method", F.lit("cue")).unionByName(
        text.score_triples(a, b, "doc_id", VOC).withColumn("method", F.lit("keyword")))


@query("f1_extractor_callable", """SELECT doc_id, 'text' AS subject, 'depends_on' AS relation, lang AS object FROM documents WHERE n_chars > 2000""")
def _(spark, d):
    def by_length(df):
        return df.filter(F.col("n_chars") > 2000).select("doc_id", F.lit("text").alias("subject"), F.lit("depends_on").alias("relation"), F.col("lang").alias("object"))
    return text.extract_all(read(spark, d, "documents"), "doc_id", "text", extractor=by_length)


# ================================================================== gates

_WS = "[\\s\\p{Z}\\x{0B}\\x{85}]+"
_WORDS = lambda e: f"CASE WHEN trim(regexp_replace({e}, '{_WS}', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({e}, '{_WS}', ' ', 'g')), ' ')) END"
_esc = lambda w: w.lower().replace("'", "''")
_any = lambda e, ws: "(" + " OR ".join(f"contains({e}, '{_esc(w)}')" for w in ws) + ")"


@query("l10_word_count", f"SELECT doc_id, CAST({_WORDS('text')} AS INTEGER) AS n_words, {_any('lower(text)', gates.SENTINELS)} AS placeholder FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", text.word_count(F.col("text")).alias("n_words"), gates.has_placeholder(F.col("text")).alias("placeholder"))


CTE["cit"] = f"""cit AS (SELECT doc_id, t, lower(t) AS low, {_WORDS('t')} AS w,
    len(list_filter(string_split_regex(t, ';\\s*\\n'), lambda p: trim(regexp_replace(p, '{_WS}', ' ', 'g')) <> '')) >= 2 AS multi FROM (
    SELECT doc_id, regexp_replace(regexp_replace(text, '^{_WS}', ''), '{_WS}$', '') AS t FROM documents)),
cv AS (SELECT doc_id, t, CASE WHEN t = '' THEN ['empty'] ELSE list_filter([
    CASE WHEN {_any('low', gates.SENTINELS)} THEN 'placeholder' END,
    CASE WHEN NOT regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(19|20)\\p{{Nd}}{{2}}([^\\p{{L}}\\p{{N}}_]|$)') THEN 'no_year' END,
    CASE WHEN NOT {_any('low', gates.VENUES)} THEN 'no_venue' END,
    CASE WHEN NOT (regexp_matches(t, '(?i)arXiv:\\s*\\d{{4}}\\.\\d{{4,5}}') OR {_any('t', gates.QUOTES)}) THEN 'no_id_or_title' END,
    CASE WHEN NOT {_any('low', gates.RELEVANCE)} THEN 'no_relevance' END,
    CASE WHEN regexp_matches(t, '^\\(\\w+\\d{{4}}\\)$') THEN 'bare_tag' END,
    CASE WHEN w < CASE WHEN multi THEN 80 ELSE 40 END THEN 'too_short' END], lambda x: x IS NOT NULL) END AS v, w, low FROM cit)"""


@query("l8_citation_gate", with_("cit", "SELECT doc_id, array_to_string(v, ',') AS violations, len(v) = 0 AS passed FROM cv"))
def _(spark, d):
    v = gates.check_citations(docs(spark, d), "text")
    return v.select("doc_id", F.array_join("violations", ",").alias("violations"), (F.size("violations") == 0).alias("passed"))


_RANGE_SQL = "[+\\-]?\\d+(?:\\.\\d+)?\\s*(?:to|[-–])\\s*[+\\-]?\\d+(?:\\.\\d+)?"


def _annotation_sql(post):
    fl = [("diagnosis", 60), ("hypothesis", 50), ("prediction", 25)] + ([("verdict", 30), ("learning", 40)] if post else [])
    kw = ["hypothesis"] + (["verdict", "learning"] if post else [])
    ph = ["diagnosis", "citations", "hypothesis", "prediction"] + (["verdict", "learning"] if post else [])
    parts = [f"CASE WHEN w < {n} THEN '{f}_too_short' END" for f, n in fl]
    parts += [f"CASE WHEN NOT {_any('low', gates.KEYWORDS[f])} THEN '{f}_keyword' END" for f in kw]
    parts += [f"CASE WHEN NOT regexp_matches(t, '{_RANGE_SQL}') THEN 'prediction_range' END"]
    parts += [f"CASE WHEN {_any('low', gates.SENTINELS)} THEN '{f}_placeholder' END" for f in ph]
    return with_("cit", f"""SELECT doc_id, array_to_string(list_concat(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL),
        list_transform(v, lambda x: 'citations:' || x)), ',') AS violations FROM cv""")


def _annotations(spark, d):
    names = ["diagnosis", "citations", "hypothesis", "prediction", "verdict", "learning"]
    return docs(spark, d).select("doc_id", *[F.col("text").alias(n) for n in names])


@query("l9_annotation_gate_before", _annotation_sql(False))
def _(spark, d):
    return gates.check_annotations(_annotations(spark, d)).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("l9_annotation_gate_after", _annotation_sql(True))
def _(spark, d):
    return gates.check_annotations(_annotations(spark, d), True).select("doc_id", F.array_join("violations", ",").alias("violations"))


# ================================================================== ledger

FP = ("rmse", False, 0.5, -2.0)
CTE["ledger"] = f"""lfold AS (SELECT o_custkey % 5 AS project, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS experiment_num, o_orderpriority AS pr,
    round(sum(o_totalprice), 2) AS s, count(*) AS n FROM orders GROUP BY 1, 2, 3),
lrow AS (SELECT project, experiment_num, list(s / n / 100000.0 ORDER BY pr) AS folds, max(s / n) / 100000.0 AS val_primary, min(s / n) / 100000.0 AS test_primary FROM lfold GROUP BY 1, 2),
ledger AS (SELECT *, least(-val_primary, -test_primary) - 0.5 * len(list_filter(folds, lambda v: -v < -2.0)) AS composite FROM lrow)"""


def ledger_rows(spark, d):
    """One experiment per project and month; the folds are the order priorities."""
    per = read(spark, d, "orders").groupBy(
        (F.col("o_custkey") % 5).alias("project"), ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).alias("experiment_num"),
        F.col("o_orderpriority").alias("pr")).agg((F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))).alias("m"))
    folds = F.transform(F.array_sort(F.collect_list(F.struct("pr", "m"))), lambda s: s["m"] / 100000.0)   # one entry per priority
    x = per.groupBy("project", "experiment_num").agg(folds.alias("per_fold_test"), (F.max("m") / 100000.0).alias("val_primary"),
                                                     (F.min("m") / 100000.0).alias("test_primary"))
    return x.withColumn("composite", ledger.composite(F.col("val_primary"), F.col("test_primary"), F.col("per_fold_test"),
                                                      higher_is_better=FP[1], penalty=FP[2], threshold=FP[3])) \
        .withColumn("composite_fingerprint", F.lit(ledger.fingerprint(*FP)))


@query("g27_ledger_composite", with_("ledger", "SELECT project, experiment_num, composite FROM ledger"), "9: composite")
def _(spark, d):
    return ledger_rows(spark, d).select("project", "experiment_num", "composite")


@query("w20_running_champion", with_("ledger", """SELECT project, experiment_num, CASE WHEN prev IS NULL OR composite > prev THEN 'KEEP' ELSE 'DISCARD' END AS status FROM (
    SELECT *, max(composite) OVER (PARTITION BY project ORDER BY experiment_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ledger)"""))
def _(spark, d):
    # at most one experiment per month and project
    return ledger.champions(ledger_rows(spark, d), ["project"], hot_rows=None).select("project", "experiment_num", "status")


@query("l11_metric_fingerprint", """SELECT p_partkey, substr(sha256(p_type || '|' || CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END || '|' || CAST(p_size / 10.0::DOUBLE AS VARCHAR)
    || '|' || CAST(-p_retailprice AS VARCHAR)), 1, 16) AS fingerprint FROM part""")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", ledger.fingerprint_column(
        F.col("p_type"), F.col("p_size") % 2 == 0, F.col("p_size") / 10.0, -F.col("p_retailprice")).alias("fingerprint"))


@query("s3_ledger_append_scan", with_("ledger", "SELECT experiment_num, val_primary, test_primary, composite, CAST(len(folds) AS INTEGER) AS n_folds FROM ledger"), "9: val_primary test_primary composite")
def _(spark, d):
    path = shared_dir(spark, "ledger")
    rows = ledger_rows(spark, d).drop("project")
    ledger.append(rows.filter("experiment_num % 2 = 0"), path)
    ledger.append(rows.filter("experiment_num % 2 = 1"), path)
    return ledger.scan(spark, path).select("experiment_num", "val_primary", "test_primary", "composite", F.size("per_fold_test").alias("n_folds"))


@query("s4_frozen_fingerprint", with_("ledger", "SELECT project, substr(sha256('rmse|False|0.5|-2.0'), 1, 16) AS fingerprint FROM ledger GROUP BY 1"))
def _(spark, d):
    return ledger.frozen_fingerprint(ledger_rows(spark, d), ["project"])


_PH = ledger.PLACEHOLDER
_merge_cols = ", ".join(f"CASE WHEN p.doc_id IS NOT NULL THEN p.lang ELSE '{_PH.format(t)}' END AS {t}" for t in ("diagnosis", "citations", "hypothesis", "prediction"))


@query("l13_annotation_merge", f"""SELECT coalesce(p.doc_id, q.doc_id) AS experiment_num, {_merge_cols}, coalesce(q.source, '') AS verdict, coalesce(q.lang, '') AS learning,
    p.doc_id IS NOT NULL AS manual, p.doc_id IS NULL AS needs_rewrite FROM (SELECT * FROM documents WHERE n_chars > 1000) p
    FULL OUTER JOIN (SELECT * FROM documents WHERE lang IN ('en', 'de')) q ON p.doc_id = q.doc_id""")
def _(spark, d):
    x = read(spark, d, "documents")
    pre = x.filter(F.col("n_chars") > 1000).select(F.col("doc_id").alias("experiment_num"), *[F.col("lang").alias(t) for t in ("diagnosis", "citations", "hypothesis", "prediction")])
    post = x.filter(F.col("lang").isin("en", "de")).select(F.col("doc_id").alias("experiment_num"), F.col("source").alias("verdict"), F.col("lang").alias("learning"))
    return ledger.merge_annotations(pre, post)


@query("l12_fingerprint_assertion", with_("ledger", "SELECT project, count(*) AS n FROM ledger GROUP BY 1"))
def _(spark, d):
    rows = ledger_rows(spark, d)
    ledger.assert_fingerprint(ledger.fingerprint(*FP), rows)   # raises if the metric definition moved
    return rows.groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query("c14_ledger_loop", with_("ledger", """SELECT project, count(*) AS n_experiments, count(*) FILTER (WHERE prev IS NULL OR composite > prev) AS n_keep, max(composite) AS best FROM (
    SELECT *, max(composite) OVER (PARTITION BY project ORDER BY experiment_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ledger) GROUP BY 1"""), "9: best")
def _(spark, d):
    rows = ledger_rows(spark, d)
    ledger.assert_fingerprint(ledger.fingerprint(*FP), rows)
    c = ledger.champions(rows, ["project"], hot_rows=None)
    return c.groupBy("project").agg(F.count(F.lit(1)).alias("n_experiments"), F.count_if(F.col("status") == "KEEP").alias("n_keep"),
                                    F.max("composite").alias("best"))


# ================================================================== profiles


@query("g23_record_counts", """SELECT source, count(*) AS n, count(*) FILTER (WHERE text IS NOT NULL AND text <> '') AS with_text, count(DISTINCT lang) AS langs FROM documents GROUP BY 1""")
def _(spark, d):
    return profile.counts(read(spark, d, "documents"), ["source"], {"with_text": "text"}, {"langs": "lang"})


@query("t1k_top_values", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 15")
def _(spark, d):
    return profile.top_k(read(spark, d, "lineitem"), "l_partkey", 15)


@query("o11_checklist", with_("cit", """SELECT 'citation' AS check_name, CASE WHEN count(*) FILTER (WHERE len(v) > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
    count(*) FILTER (WHERE len(v) > 0) AS n_failed FROM cv UNION ALL SELECT 'has_text', CASE WHEN count(*) FILTER (WHERE NOT n_chars > 0) = 0 THEN 'PASS' ELSE 'FAIL' END,
    count(*) FILTER (WHERE NOT n_chars > 0) FROM documents"""))
def _(spark, d):
    x = read(spark, d, "documents").select("text", "n_chars")
    return gates.checklist({"citation": gates.check_citations(x, "text").select((F.size("violations") == 0).alias("passed")),
                            "has_text": x.select((F.col("n_chars") > 0).alias("passed"))})
