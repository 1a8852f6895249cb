"""URL filters: rules first, then gradient-boosted trees on lexical features, in DataFrame functions only.

A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule decides. For the
other urls, trees trained on the urls that rules decide (at most FIT_ROWS of them, chosen by hash) judge length, depth,
digit ratio, entropy, parameter counts and statistics of the host's suffix, which are taken over all urls.

Null urls and those without ``://`` have empty host and path and no rule; the trees judge their features like any
others. If the decided urls are all of one kind, that verdict stands for the rest; without any, the rest is allowed.
Repeated rows are judged alike, and count once in the fit. All other columns are kept, whatever their names. The trees'
size (12 rounds of depth 4) is a setting like any other.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlab.llm.common import stored

ALLOW, BLOCK = "allow", "block"
#: Decided urls that the trees are fitted on, chosen by the hash of the url.
FIT_ROWS = 8_000
FEATURES = ("length", "host_length", "depth", "labels", "digits", "hyphens", "entropy", "parameters", "suffix_rows", "suffix_blocked")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest of the rules (verdict, host and path as one text) that fits, as (rule, verdict), or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # later, longer ones are asked first
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _lexical(urls: DataFrame) -> DataFrame:
    """The features that a url alone gives; needs __url and __host."""
    url, n = F.col("__url"), F.length("__url")
    letters = F.array_distinct(F.split(url, ""))
    # Entropy over characters: those that differ, each with its share.
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    count = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    return urls.withColumns({
        "length": n.cast("double"), "host_length": F.length("__host").cast("double"), "depth": count("/"),
        "labels": F.size(F.split("__host", r"\.")).cast("double"), "digits": count("[0-9]") / F.greatest(n, F.lit(1)),
        "hyphens": count("[-_%]"), "entropy": F.when(n > 0, entropy).otherwise(0.0), "parameters": count("[?&][^=&#]*="),
        "__suffix": F.element_at(F.split("__host", r"\."), -1)})


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], rows: int = FIT_ROWS) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced."""
    pages = pages.drop("host", "path", "rule", "verdict")
    own = {c: f"__own_{i}" for i, c in enumerate(pages.columns)}  # no column is taken for a feature
    urls = pages.withColumnsRenamed({c: n for c, n in own.items() if c != "url"}).withColumn("__url", F.coalesce("url", F.lit("")))
    host, path = url_parts(F.col("__url"))
    urls = _lexical(urls.withColumns({"__host": host, "__path": path}).withColumn(
        "__rule", longest_rule(rules, F.col("__host"), F.col("__path"))))
    blocked = F.when(F.col("__rule.verdict") == BLOCK, 1.0).when(F.col("__rule.verdict") == ALLOW, 0.0)
    urls = stored(urls.withColumn("__label", blocked), "urls")
    overall = urls.agg(F.avg("__label").alias("share"), F.count("*").alias("n")).first()
    # Suffix statistics come from partial counts; the shares are drawn towards the overall one where rows are few.
    prior = 0.0 if overall["share"] is None else overall["share"]
    suffixes = urls.groupBy("__suffix").agg(
        F.log1p(F.count("*")).alias("suffix_rows"),
        F.coalesce(F.sum("__label"), F.lit(0.0)).alias("__sum"), F.count("__label").alias("__labels"))
    # A decided url's own label is no part of its suffix's share: the trees must not read the answer off the feature.
    mine = F.col("__label").isNotNull()
    known = urls.join(suffixes, "__suffix").withColumn("suffix_blocked", (
        F.col("__sum") - F.when(mine, F.col("__label")).otherwise(0.0) + 5 * prior) / (F.col("__labels") - F.when(mine, 1).otherwise(0) + 5))
    decided = {r["__label"] for r in urls.where("__label is not null").select("__label").distinct().collect()}
    if len(decided) < 2:
        rest = F.lit(BLOCK if decided == {1.0} else ALLOW)
        judged = urls.withColumn("__other", rest)
    else:
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
        fit = stored(known.where("__label is not null").dropDuplicates(["__url"]).orderBy(F.xxhash64("__url"), "__url").limit(rows)
                     .select(*FEATURES, "__label"), "fit")
        trees = GBTClassifier(featuresCol="__features", labelCol="__label", predictionCol="__block", maxIter=12, maxDepth=4,
                              maxBins=64, stepSize=0.3, seed=17).setRawPredictionCol("").setProbabilityCol("")
        model = trees.fit(assemble.transform(fit))
        judged = model.transform(assemble.transform(known)).withColumn(
            "__other", F.when(F.col("__block") > 0.5, BLOCK).otherwise(ALLOW))
    return judged.select(
        *[F.col(n if c != "url" else c).alias(c) for c, n in own.items()], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", "__other").alias("verdict"))
