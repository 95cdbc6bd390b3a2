"""URL filter: host/path rules, then a ratio of two character language models.

Rules decide the urls they fit. The rest is judged by two variable-order Markov
models over characters, one of the urls that rules allow and one of those that
they block. A character is predicted from the longest context seen, smoothed
down to shorter ones (Witten-Bell): P_k(c|x) = (n(xc) + T(x) P_{k-1}(c|x')) /
(n(x) + T(x)), T being the number of different characters seen after x. A url's
score is the mean over its characters of log2 P_allow - log2 P_block.

The threshold is calibrated on ruled urls that the models have not learnt from
(one fifth, by hash of the url): scores are counted in 2**-6 steps and the
threshold with the lowest sum of both error rates is taken (ties: nearest 0).

Only DataFrame operations. All counts come from all urls: every url's n-grams
are counted once at full order, the shorter ones are sums of these. A common
n-gram (a hot key) is pre-aggregated when counted, and split by the adaptive
skew join when scores go back to the urls.

Defined results: a null url or one without ``://`` has an empty host and path;
no rule fits it, and an empty or null url scores 0 and is judged like any score
(0 against the threshold). Characters outside printable ASCII share one symbol.
Without ruled urls of both kinds the threshold is 0 and scores rest on the
smoothing alone. Repeated rows are judged each; ids may be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, free_name, materialise, without

# Fixed values: (verdict, host, path); the first "/" parts host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4            # longest context in characters
ALPHABET = 97        # printable ASCII, one symbol for the rest, one for the start
START, OTHER = "\x02", "\x01"
STEP = 1.0 / 64
UNITS = 1 << 24
HOLD_OUT = 5         # one in so many ruled urls calibrates


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) columns; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES):
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, r_host, r_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        rule = F.when(fits, F.lit(r_host + r_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def ngrams(url: Column, order: int = ORDER) -> Column:
    """All (order + 1)-character strings ending at each character of a url."""
    plain = F.regexp_replace(ascii_lower(url), r"[^\x20-\x7E]", OTHER)
    padded = F.concat(F.lit(START * order), plain)
    n = F.length(plain)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n),
                                     lambda i: F.substring(padded, i, F.lit(order + 1))))


def fit_models(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n_allow, n_block) -> (gram, ratio): log2 of the two models'
    probabilities of each gram's last character after its context."""
    below = None
    for k in range(order + 1):
        gram = F.col("gram") if k == order else F.substring("gram", order - k + 1, k + 1)
        n = (grams.groupBy(gram.alias("g")).agg(F.sum("n_allow").alias("a"),
                                                F.sum("n_block").alias("b"))
             .withColumn("x", F.substring("g", 1, k)))
        after = n.groupBy("x").agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"),
            F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))
        here = n.join(after, "x")
        if below is None:
            here = here.withColumns({"pa": F.lit(1.0 / ALPHABET), "pb": F.lit(1.0 / ALPHABET)})
        else:
            here = (here.withColumn("y", F.substring("g", 2, k))
                    .join(below.withColumnRenamed("g", "y"), "y"))
        smooth = lambda c, n_, t, p: F.when(
            F.col(n_) > 0, (F.col(c) + F.col(t) * F.col(p)) / (F.col(n_) + F.col(t))
        ).otherwise(F.col(p))
        below = here.select("g", smooth("a", "na", "ta", "pa").alias("pa"),
                            smooth("b", "nb", "tb", "pb").alias("pb"))
    return below.select(F.col("g").alias("gram"),
                        (F.log2("pa") - F.log2("pb")).alias("ratio"))


def calibrated(held: DataFrame) -> DataFrame:
    """(score, verdict) of held-out ruled urls -> one row: the threshold."""
    step = F.greatest(F.lit(-1024), F.least(F.lit(1024), F.floor(F.col("score") / STEP)))
    # at most 2049 steps whatever the input
    counts = held.groupBy(step.cast("int").alias("s")).agg(
        F.count_if(F.col("verdict") == "allow").alias("a"),
        F.count_if(F.col("verdict") == "block").alias("b"))
    upto, whole = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    errors = (counts
              .withColumn("a_below", F.coalesce(F.sum("a").over(upto), F.lit(0)))
              .withColumn("b_below", F.coalesce(F.sum("b").over(upto), F.lit(0)))
              .withColumn("na", F.sum("a").over(whole)).withColumn("nb", F.sum("b").over(whole))
              .filter("na > 0 and nb > 0")
              .withColumn("e", F.col("a_below") / F.col("na")
                          + (F.col("nb") - F.col("b_below")) / F.col("nb")))
    best = errors.agg(F.min(F.struct("e", F.abs("s").alias("m"), "s")).alias("best"))
    return best.select(F.coalesce(F.col("best.s") * STEP, F.lit(0.0)).alias("threshold"))


def filter_urls(df: DataFrame, url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """``df`` with host, path, rule, verdict (allow or block) and score."""
    result = {"host", "path", "rule", "verdict", "score"}
    rows = without(df, result - {url_col})
    host, path = split_url(F.col(url_col))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = (rows.withColumns({"host": host, "path": path})
              .withColumns({"rule": rule, "verdict": verdict}))
    key = free_name(judged, "url_key")
    # a url's judgement depends on the url alone: equal urls are scored once
    urls = materialise(
        judged.filter(F.length(F.col(url_col)) > 0)
        .groupBy(F.col(url_col).alias("url_key"), F.col("verdict").alias("ruled"))
        .agg(F.count("*").alias("rows"))
        # a url becomes some fifty n-grams: spread the few bytes of urls first
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url_key")
        .withColumn("id", F.monotonically_increasing_id())
        .withColumn("held", F.pmod(F.xxhash64(F.lit(5), "url_key"), F.lit(HOLD_OUT)) == 0), "urls")
    grams = urls.select("id", "ruled", "held", "rows",
                        F.explode(ngrams(F.col("url_key"), order)).alias("gram"))
    learnt = lambda what: F.sum(F.when((F.col("ruled") == what) & ~F.col("held"),
                                       F.col("rows")).otherwise(F.lit(0)))
    counts = grams.groupBy("gram").agg(learnt("allow").alias("n_allow"),
                                       learnt("block").alias("n_block"))
    models = materialise(fit_models(materialise(counts, "url-grams"), order), "url-models")
    # whole units of 2**-24 bits: sums do not depend on the order of rows
    unit = F.round(F.col("ratio") * UNITS).cast("long")
    scored = materialise(
        grams.select("id", "gram").join(models, "gram").select("id", unit.alias("unit"))
        .groupBy("id").agg((F.sum("unit") / (F.count("*") * F.lit(float(UNITS)))).alias("score"))
        .join(urls.select("id", "url_key", "ruled", "held"), "id"), "url-scores")
    held = scored.filter("held and ruled is not null").select("score", F.col("ruled").alias("verdict"))
    threshold = calibrated(held).scalar()
    found = scored.select(F.col("url_key").alias(key), "score")
    out = judged.withColumn(key, F.col(url_col)).join(found, key, "left").drop(key)
    score = F.coalesce(F.col("score"), F.lit(0.0))
    by_model = F.when(score >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return (out.withColumn("verdict", F.coalesce(F.col("verdict"), by_model))
            .withColumn("score", score))
