"""URL filter: host and path rules, and for the rest gradient-boosted trees on lexical features.

The longest rule whose host is the url's host or a parent domain and whose path starts the url's path decides. Urls that a
rule decides are the labelled ones; trees boosted on their lexical features judge the others. Everything is DataFrame
expressions and Spark's own tree learner, no Python runs in tasks.

Features: lengths of url, host, path and query, path depth, host labels, digit ratio, character entropy, hyphens, parameter
counts, and statistics of the host's last label and of the last path segment's ending (number and share of blocked among
the labelled, additively smoothed). Suffix statistics cover all labelled rows. The trees are fitted on at most
``FIT_ROWS`` labelled rows, those with the smallest hash of the url, so that fitting does not grow with the input.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.llm.common import table
from landlens.session import materialise

#: verdict, host, path (without the slash that starts it)
RULES = [("allow", "com", ""), ("block", "example.com", "en/"), ("allow", "www.example.com", "en/"), ("block", "net", "es/"), ("block", "net", "fr/")]
#: Labelled rows that the trees are fitted on, at most.
FIT_ROWS = 20_000
TREES, DEPTH, SEED = 10, 4, 7
#: A score of at least this blocks.
THRESHOLD = 0.5
#: Weight of the overall share in suffix statistics.
PRIOR = 20.0


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    cut = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Behind the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(f"{r[1]}/{r[2]}"), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        if not rule_path:  # a bare host also fits an empty path
            fits = (host == rule_host) | host.endswith("." + rule_host)
        value = F.struct(F.lit(f"{rule_host}/{rule_path}").alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def entropy(text: Column) -> Column:
    """Bits per character over the distinct characters."""
    chars, n = F.split(text, ""), F.length(text).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: F.when(c == "", 0.0).otherwise((F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n))
    return F.when(n > 0, -F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def judged(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, verdict (null where no rule fits), domain and ending."""
    out = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    out = out.withColumn("__rule", matching_rule(F.col("host"), F.col("path")))
    return out.select(
        "page_id", "url", "host", "path", F.col("__rule.rule").alias("rule"), F.col("__rule.verdict").alias("verdict"),
        F.regexp_extract("host", r"[^.]*$", 0).alias("domain"), F.regexp_extract("path", r"\.([a-z0-9]{1,5})$", 1).alias("ending"),
    )


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, r"[^0-9]", ""))
    columns = {
        "f_url": F.length(url), "f_host": F.length("host"), "f_path": F.length("path"), "f_query": F.length(query),
        "f_depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")), "f_labels": F.size(F.split("host", r"\.")),
        "f_digits": F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0), "f_entropy": entropy(url),
        "f_hyphens": F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit(""))),
        "f_parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "f_first": F.length(F.regexp_extract("host", r"^[^.]*", 0)),
    }
    return rows.withColumns({k: v.cast("double") for k, v in columns.items()}), list(columns)


def with_suffix_statistics(rows: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """Add how often a suffix was labelled and its smoothed share of blocked ones.

    The statistics have a row per suffix seen among labelled urls and are joined by size as Spark measures it; an own row's
    label is left out of its share, so that a rare suffix does not give it away.
    """
    labelled = rows.where(F.col("verdict").isNotNull())
    blocked = (F.col("verdict") == "block").cast("double")
    stats = labelled.groupBy(F.col(column).alias("__s")).agg(F.count("*").cast("double").alias("__n"), F.sum(blocked).alias("__b"))
    own = F.col("verdict").isNotNull().cast("double")
    n = F.coalesce("__n", F.lit(0.0)) - own
    b = F.coalesce("__b", F.lit(0.0)) - F.coalesce(blocked, F.lit(0.0))
    out = rows.join(stats, F.col(column) == F.col("__s"), "left")
    out = out.withColumn(f"f_{column}_n", F.log1p(n)).withColumn(f"f_{column}_blocked", (b + 0.5 * PRIOR) / (n + PRIOR))
    return out.drop("__s", "__n", "__b"), [f"f_{column}_n", f"f_{column}_blocked"]


def filter_urls(pages: DataFrame, fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of ``pages``; other columns are not looked at.

    A null url, or one without ``://``, has an empty host and path. Where the labelled urls hold one kind only, or none, the
    trees cannot be fitted: the others get that kind's score, or 0 and ``allow`` where nothing is labelled.
    """
    rows, names = features(judged(pages))
    for column in ("domain", "ending"):
        rows, more = with_suffix_statistics(rows, column)
        names += more
    rows = materialise(rows.select("page_id", "url", "host", "path", "rule", "verdict", *names), "url-features")
    labelled = rows.where(F.col("verdict").isNotNull()).withColumn("label", (F.col("verdict") == "block").cast("double"))
    kinds = [r["label"] for r in labelled.select("label").distinct().collect()]  # two at most
    if len(kinds) < 2:
        score = F.lit(kinds[0] if kinds else 0.0)
    else:
        assemble = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
        sample = labelled.orderBy(F.xxhash64("url"), "page_id").limit(fit_rows).select("label", *names)
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=SEED, checkpointInterval=-1).fit(assemble.transform(sample))
        rows = model.transform(assemble.transform(rows))
        score = vector_to_array("probability")[1]
    verdict = F.coalesce("verdict", F.when(score >= THRESHOLD, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
