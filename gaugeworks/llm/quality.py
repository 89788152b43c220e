"""Quality rules with adaptive limits: quantile sketches per language and source, in DataFrame operations only.

A sketch is a table of counts per log-linear bucket (32 buckets for each power of
two, so a value is known to one part in 32).  Sketches of two groups merge by
adding counts, which is how small groups borrow the limits of their language or
of the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import SPACE, small_enough, store, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: A group with fewer documents than this uses the merged sketch one level up.
MIN_GROUP = 200
#: Limits lie REACH spreads beyond the quartiles; a spread is the distance of the quartiles or this slack, if larger.
REACH = 3
SLACK = {"symbols": 20, "length": 500, "lines": 150, "repeats": 70}
#: The mean word length is taken over the text and this many words of this many characters, which steadies short texts.
PRIOR_WORDS, PRIOR_CHARS = 20, 5
BROADCAST_GROUPS = 20_000

ROW, NUMBERS = "row", ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _measure(docs: DataFrame, text: Column) -> DataFrame:
    """``row`` (all columns of ``docs``) and the numbers of NUMBERS."""
    t = F.coalesce(text, F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), t.alias("t"))
    base = base.withColumn("w", words(F.col("t"))).withColumn(
        "l", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    hashes = F.when(F.size("w") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])))
    base = base.withColumn("h", F.coalesce(hashes, F.array().cast("array<bigint>")))
    base = base.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = F.filter("s", lambda e, i: ((i > 0) & (F.get("s", i - 1)["x"] == e["x"])) | (F.get("s", i + 1)["x"] == e["x"]))
    base = base.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(twice, lambda e: e["i"]))))
    gaps = F.zip_with(F.slice("p", 2, F.size("p") - 1), F.slice("p", 1, F.size("p") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    repeat = F.when(F.col("p").isNull(), 0).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x))
    return base.select(
        ROW, F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"), F.size("l").cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """Whole numbers: symbols per thousand characters, thousandths of a character per word, repeats per thousand."""
    def per(a: str, b: str) -> Column:
        return F.expr(f"(1000 * {a}) div greatest({b}, 1L)")
    return {"symbols": per("n_symbols", "word_chars"), "length": per(f"(word_chars + {PRIOR_WORDS * PRIOR_CHARS})", f"(n_words + {PRIOR_WORDS})"),
            "lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def bucket(x: Column) -> Column:
    """Log-linear bucket: whole numbers below 64 as they are, then 32 for each power of two."""
    e = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return (e * 64 + F.call_function("shiftright", x, e)).cast("long")


def bucket_floor(b: Column) -> Column:
    """Smallest number in a bucket."""
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b % 64, F.floor(b / 64).cast("int"))).cast("long")


def sketches(measured: DataFrame, group: list[str]) -> DataFrame:
    """``level, <group>, metric, bucket, n`` at three levels: the whole group, its first key, everything."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics().items()]))
    rows = measured.where(~base_failed()).select(*group, named.alias("m")).select(*group, "m.metric", "m.bucket")
    fine = rows.groupBy(*group, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))
    lifted = [fine.withColumn("level", F.lit(2))]
    for level in (1, 0):
        kept = group[:level]
        up = fine.groupBy(*kept, "metric", "bucket").agg(F.sum("n").alias("n"))
        lifted.append(up.select(*kept, *[F.lit(None).cast("string").alias(g) for g in group[level:]], "metric", "bucket", "n", F.lit(level).alias("level")))
    out = lifted[0]
    for x in lifted[1:]:
        out = out.unionByName(x)
    return out


def limits(sketch: DataFrame, group: list[str], min_group: int = MIN_GROUP) -> DataFrame:
    """``<group>, low_length, high_<metric>`` for every group, from the finest level with enough documents."""
    w = Window.partitionBy("level", *group, "metric")
    run = sketch.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    quartiles = run.groupBy("level", *group, "metric").agg(bucket_floor(at(1)).alias("q1"), bucket_floor(at(3)).alias("q3"), F.max("total").alias("total"))
    slack = F.create_map(*[x for k, v in SLACK.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    spread = F.lit(REACH) * F.greatest(F.col("q3") - F.col("q1"), slack[F.col("metric")])
    wide = quartiles.withColumn("spread", spread).groupBy("level", *group).agg(
        F.max("total").alias("total"), F.max(F.when(F.col("metric") == "length", F.col("q1") - F.col("spread"))).alias("low_length"),
        *[F.max(F.when(F.col("metric") == k, F.col("q3") + F.col("spread"))).alias(f"high_{k}") for k in SLACK])
    bounds = F.struct("low_length", *[f"high_{k}" for k in SLACK])
    level = lambda n, name, keys: wide.where(F.col("level") == n).select(*[F.col(g).alias(f"{g}_{n}") for g in keys], F.when((F.col("total") >= min_group) | F.lit(n == 0), bounds).alias(name))
    a, b = group
    out = level(2, "own", group).join(level(1, "mid", [a]), F.col(f"{a}_2").eqNullSafe(F.col(f"{a}_1")), "left").join(level(0, "all", []), F.lit(True), "left")
    return out.select(F.col(f"{a}_2").alias(a), F.col(f"{b}_2").alias(b), F.coalesce("own", "mid", "all").alias("limit")).select(a, b, "limit.*")


def judge(measured: DataFrame, lang: Column, source: Column, min_group: int = MIN_GROUP) -> DataFrame:
    """``measured`` with base_failed and kept; rows of a group without limits fail the base rules anyway."""
    keyed = measured.withColumns({"_lang": lang, "_source": source})
    bound = store(limits(sketches(keyed, ["_lang", "_source"]), ["_lang", "_source"], min_group), "quality-limits")
    bound = bound.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    bound = F.broadcast(bound) if small_enough(bound, BROADCAST_GROUPS) else bound
    joined = keyed.join(bound, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    m = metrics()
    inside = (m["length"] >= F.col("low_length"))
    for k in SLACK:
        inside = inside & (m[k] <= F.col(f"high_{k}"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
            min_group: int = MIN_GROUP) -> DataFrame:
    """One row of counts and verdicts per row of ``docs``.

    Null and empty texts have no words and fail.  Null languages and sources are
    groups of their own.  Windows are compared by 64-bit hashes within a text.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    got = _measure(narrow, F.col("text")).select(F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *NUMBERS)
    out = judge(store(got, "quality"), F.col("lang"), F.col("source"), min_group)
    return out.select("doc_id", *NUMBERS[:5], "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged.  Rows and counts are stored once, so that texts are measured once."""
    got = store(_measure(docs, F.col(f"`{text}`")), "quality")
    out = judge(got, F.col("row")[lang].cast("string"), F.col("row")[source].cast("string"), min_group)
    return out.where("kept").select("row.*")


def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _sql() -> str:
    value = {"symbols": "(1000 * n_symbols) // greatest(word_chars, 1)", "length": f"(1000 * (word_chars + {PRIOR_WORDS * PRIOR_CHARS})) // (n_words + {PRIOR_WORDS})",
             "lines": "(1000 * n_dup_lines) // greatest(n_lines, 1)", "repeats": "(1000 * n_repeat_words) // greatest(n_words, 1)"}
    slack = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLACK.items())
    union = "\n  UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {v} AS x FROM measured WHERE NOT base_failed" for k, v in value.items())
    highs = ", ".join(f"max(CASE WHEN metric = '{k}' THEN q3 + spread END) AS high_{k}" for k in SLACK)
    inside = " AND ".join(f"{value[k]} <= high_{k}" for k in SLACK)
    floor = "CASE WHEN {0} < 64 THEN {0} ELSE ({0} % 64) << ({0} // 64) END"
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g, lead(x, 4) OVER o AS last
  FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE last IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
measured AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM counted),
val AS (
  {union}),
b AS (SELECT *, greatest(length(bin(x)) - 6, 0)::BIGINT AS e FROM val),
fine AS (SELECT lang, source, metric, e * 64 + (x >> e) AS bucket, count(*) AS n FROM b GROUP BY ALL),
sk AS (SELECT 2 AS level, * FROM fine
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n)::BIGINT FROM fine GROUP BY lang, metric, bucket
  UNION ALL SELECT 0, NULL, NULL, metric, bucket, sum(n)::BIGINT FROM fine GROUP BY metric, bucket),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto FROM sk),
q AS (SELECT level, lang, source, metric, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN bucket END) AS b1, min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS b3 FROM run GROUP BY ALL),
q2 AS (SELECT *, {floor.format("b1")} AS q1, {floor.format("b3")} AS q3 FROM q),
q3 AS (SELECT *, {REACH} * greatest(q3 - q1, CASE metric {slack} END) AS spread FROM q2),
wide AS (SELECT level, lang, source, max(total) AS total, max(CASE WHEN metric = 'length' THEN q1 - spread END) AS low_length, {highs} FROM q3 GROUP BY ALL),
pick AS (
  SELECT o.lang, o.source, CASE WHEN o.total >= {MIN_GROUP} THEN 2 WHEN m.total >= {MIN_GROUP} THEN 1 ELSE 0 END AS level
  FROM wide o LEFT JOIN wide m ON m.level = 1 AND m.lang IS NOT DISTINCT FROM o.lang WHERE o.level = 2),
lim AS (
  SELECT p.lang, p.source, w.* EXCLUDE (lang, source, level, total) FROM pick p JOIN wide w ON w.level = p.level
    AND (p.level = 0 OR w.lang IS NOT DISTINCT FROM p.lang) AND (p.level < 2 OR w.source IS NOT DISTINCT FROM p.source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({value["length"]} >= low_length AND {inside}, true) AS kept
FROM measured f LEFT JOIN lim ON f.lang IS NOT DISTINCT FROM lim.lang AND f.source IS NOT DISTINCT FROM lim.source
"""


SQL = _sql()
