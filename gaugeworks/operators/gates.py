"""Rule gates over text columns: arrays of violation labels, empty when the text passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import word_count

# Floors, keywords, sentinels, venue names and patterns of the gates.
WORD_FLOORS = {"diagnosis": 60, "citations_single": 40, "citations_multi": 80, "hypothesis": 50, "prediction": 25,
               "verdict": 30, "learning": 40}
KEYWORDS = {"hypothesis": ["mechanism", "because", "per "], "verdict": ["KEEP", "DISCARD", "NEAR-MISS"],
            "learning": ["axis closed", "axis open", "next try"]}
SENTINELS = ["TODO-REWRITE", "(auto-backfilled)", "(no citation tag)", "(no explicit citation)", "see research_journal.md"]
VENUES = ["NeurIPS", "ICML", "ICLR", "AAAI", "CVPR", "ACL", "EMNLP", "KDD", "TMLR", "JMLR", "COLM", "IJCAI", "IEEE",
          "arXiv", "Nature", "Science", "JGR", "GMD", "ERL", "WAF", "MWR", "QJRMS", "BAMS", "Climate Dynamics",
          "Journal of Climate", "Geophysical", "Technometrics", "Environmetrics", "JRSS", "Annals of Applied Statistics",
          "Remote Sensing of Environment", "Water Resources Research", "Econometrica", "JASA", "Neural Computation",
          "Atmospheric Environment", "OTexts", "Springer", "Wiley"]
RELEVANCE = ["— ", " - ", "because", "motivates", "per ", "requires", "suggests", "predicts", "informs"]
QUOTES = ["'", '"', "‘", "“"]
YEAR = r"\b(19|20)\d{2}\b"
ARXIV = r"(?i)arXiv:\s*\d{4}\.\d{4,5}"
BARE_TAG = r"^\(\w+\d{4}\)$"
RANGE = r"[+\-]?\d+(?:\.\d+)?\s*(?:to|[-–])\s*[+\-]?\d+(?:\.\d+)?"


def _any_of(lower: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(lower, F.lit(w.lower()))
    return cond


def has_placeholder(text: Column) -> Column:
    return _any_of(F.lower(F.coalesce(text, F.lit(""))), SENTINELS)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def _citation_checks(t: str, low: str, words: str) -> dict[str, Column]:
    """Rule name -> violated?, over the prepared columns (trimmed, lower-cased, word count)."""
    papers = F.filter(F.split(t, r";\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")) != "")
    multi = F.contains(F.col(t), F.lit(";")) & (F.size(papers) >= 2)
    quoted = F.lit(False)
    for q in QUOTES:
        quoted = quoted | F.contains(F.col(t), F.lit(q))
    return {"placeholder": _any_of(F.col(low), SENTINELS),
            "no_year": ~F.col(t).rlike("(?U)" + YEAR),
            "no_venue": ~_any_of(F.col(low), VENUES),
            "no_id_or_title": ~(F.col(t).rlike(ARXIV) | quoted),
            "no_relevance": ~_any_of(F.col(low), RELEVANCE),
            "bare_tag": F.col(t).rlike("(?U)" + BARE_TAG),
            "too_short": F.col(words) < F.when(multi, WORD_FLOORS["citations_multi"]).otherwise(WORD_FLOORS["citations_single"])}


def _labels(flags: list[str], prefix: str) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f"{prefix}{n}"), n) for n in flags]))


def check_citations(df: DataFrame, text: str, out: str = "violations") -> DataFrame:
    """Array of violated citation rules, in rule order; ``["empty"]`` for blank text.

    Text is trimmed, lower-cased and counted once per row in its own
    projection; the rules are plain boolean columns over those.
    """
    d = df.withColumn("_ct", _trimmed(F.col(text)))
    d = d.withColumns({"_cl": F.lower("_ct"), "_cw": word_count(F.col(text))})
    checks = _citation_checks("_ct", "_cl", "_cw")
    d = d.withColumns({f"_cf_{n}": c for n, c in checks.items()})
    d = d.withColumn(out, F.when(F.col("_ct") == "", F.array(F.lit("empty"))).otherwise(_labels(list(checks), "_cf_")))
    return d.drop("_ct", "_cl", "_cw", *[f"_cf_{n}" for n in checks])


def check_annotations(df: DataFrame, post_run: bool = False) -> DataFrame:
    """Adds ``violations`` and ``passed``: word floors, keywords, numeric range, placeholders, citation rules.

    Before a run only diagnosis, citations, hypothesis and prediction count;
    ``post_run`` adds verdict and learning.
    """
    extra = ["verdict", "learning"] if post_run else []
    texts = ["diagnosis", "citations", "hypothesis", "prediction"] + extra
    d = check_citations(df, "citations", "_cite")
    d = d.withColumns({f"_l_{f}": F.lower(F.coalesce(F.col(f), F.lit(""))) for f in texts})
    d = d.withColumns({f"_w_{f}": word_count(F.col(f)) for f in texts if f != "citations"})
    checks = {f"{f}_too_short": F.col(f"_w_{f}") < WORD_FLOORS[f] for f in ["diagnosis", "hypothesis", "prediction"] + extra}
    checks |= {f"{f}_keyword": ~_any_of(F.col(f"_l_{f}"), KEYWORDS[f]) for f in ["hypothesis"] + extra}
    checks["prediction_range"] = ~F.coalesce(F.col("prediction"), F.lit("")).rlike(RANGE)
    checks |= {f"{f}_placeholder": _any_of(F.col(f"_l_{f}"), SENTINELS) for f in texts}
    d = d.withColumns({f"_af_{n}": c for n, c in checks.items()})
    cite = F.transform("_cite", lambda v: F.concat(F.lit("citations:"), v))
    d = d.withColumn("violations", F.concat(_labels(list(checks), "_af_"), cite)).withColumn("passed", F.size("violations") == 0)
    return d.drop("_cite", *[c for c in d.columns if c.startswith(("_l_", "_w_", "_af_"))])


def checklist(results: dict[str, DataFrame]) -> DataFrame:
    """Gate results (one boolean column ``passed`` each) as PASS / FAIL / N-A rows."""
    from functools import reduce
    rows = [d.agg(F.when(F.count(F.lit(1)) == 0, "N-A").when(F.min(F.col("passed").cast("int")) == 1, "PASS")
                  .otherwise("FAIL").alias("status"), F.count_if(~F.col("passed")).alias("n_failed"))
            .select(F.lit(name).alias("check_name"), "status", "n_failed") for name, d in results.items()]
    return reduce(DataFrame.unionByName, rows)
