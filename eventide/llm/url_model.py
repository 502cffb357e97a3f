r"""URL filters: rules first, then the likelihood ratio of two variable-order character models, with built-in functions only.

The urls that the rules allow and block train one model each. A model gives a character's probability after its context
of up to ``ORDER`` characters by Witten-Bell interpolation: at every order,
``p = (n(context, char) + T(context) * p_shorter) / (N(context) + T(context))``, where ``N`` counts the context, ``T`` its
different successors, and an unseen context passes the shorter one's probability on. A url's score is the mean over its
characters (and its end) of ``ln p_allowed - ln p_blocked``. The threshold is the score between both classes that gives
the best balanced accuracy on the labelled urls of the calibration share, which the counts leave out; all other
labelled urls, however many, are counted.

Every character place is one row ``(window)``: its context and itself. Counts and scores are worked out per distinct
window, so what is smoothed grows with the number of distinct windows, not with the text. Places, n-grams and urls are
merged: they are many more than the small files they come from let Spark guess, and a broadcast goes through the driver.

Cases: a null url and a url without ``://`` have empty host and path and no rule; the method judges them by the text they
have (none: only the end mark). Without labelled urls of both classes the threshold is 0, and a score at the threshold is
allowed. Repeated rows give repeated results; only the key and the url are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.session import stage

# Rules as host, path and verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Longest context in characters; uniform probability below order 0; one in so many labelled urls calibrates.
ORDER, UNIFORM, CALIBRATION = 4, 1 / 256, 5
#: Calibration counts scores in bins of this width, up to this size either way.
BIN, BINS = 0.01, 600
START, END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _windows(text: Column) -> Column:
    """Context and character at every place of a text, the end included."""
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def train(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``text`` and ``allowed``: counts by n-gram (all orders, told apart by length), and by context."""
    seen = labelled.select("allowed", F.explode(_windows(F.col("text"))).alias("window")).groupBy("window").agg(
        F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("b")
    )
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.substring("window", ORDER + 2 - k, k))
    grams = seen.select(F.explode(suffixes).alias("gram"), "a", "b").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    contexts = grams.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("context")).agg(
        F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb")
    )
    return grams, contexts


def ratios(windows: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per distinct ``window``: ``ln p_allowed - ln p_blocked`` of its last character."""
    orders = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.struct(k.alias("k"), F.substring("window", ORDER + 2 - k, k).alias("gram")))
    rows = windows.select("window").distinct().select("window", F.explode(orders).alias("o")).select(
        "window", "o.k", "o.gram", F.expr("substring(o.gram, 1, length(o.gram) - 1)").alias("context")
    )
    rows = rows.join(grams.hint("merge"), "gram", "left").join(contexts.hint("merge"), "context", "left")
    steps = F.sort_array(F.collect_list(F.struct("k", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("a", "b", "na", "nb", "ta", "tb")])))

    def chain(n: str, total: str, kinds: str) -> Column:
        step = lambda p, x: F.when(x[total] > 0, (x[n] + x[kinds] * p) / (x[total] + x[kinds])).otherwise(p)
        return F.aggregate("steps", F.lit(UNIFORM), step)

    return rows.groupBy("window").agg(steps.alias("steps")).select(
        "window", (F.log(chain("a", "na", "ta")) - F.log(chain("b", "nb", "tb"))).alias("ratio")
    )


def score(urls: DataFrame, grams: DataFrame, contexts: DataFrame, key: str = "text") -> DataFrame:
    """``key`` and ``score`` of rows with a ``text``, which the key tells apart: the mean ratio over the text's places."""
    places = urls.select(key, F.explode(_windows(F.col("text"))).alias("window"))
    found = places.hint("merge").join(ratios(places, grams, contexts), "window")
    # sums of whole numbers don't depend on the order in which rows arrive
    total = F.sum(F.round(F.col("ratio") * 1e9).cast("bigint"))
    return found.groupBy(key).agg((total / F.count("*") / 1e9).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """Threshold with the best balanced accuracy over rows of ``score`` and ``allowed``; of equal ones the middle."""
    bins = scored.groupBy(F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / BIN))).alias("bin")).agg(
        F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("b")
    )
    grid = bins.sparkSession.range(-BINS, BINS + 2).withColumnRenamed("id", "bin").join(bins, "bin", "left").fillna(0)
    up, down = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rates = grid.select(
        "bin", F.try_divide(F.sum("a").over(up), F.sum("a").over(Window.partitionBy())).alias("hit"),
        F.try_divide(F.coalesce(F.sum("b").over(down), F.lit(0)), F.sum("b").over(Window.partitionBy())).alias("reject"),
    ).withColumn("gain", F.round(F.col("hit") + F.col("reject"), 9))
    best = rates.agg(F.max("gain").alias("gain"))
    row = rates.join(F.broadcast(best), "gain").agg(F.min("bin").alias("low"), F.max("bin").alias("high")).first()  # one row
    return 0.0 if row["low"] is None else (row["low"] + row["high"]) / 2 * BIN


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """Columns: the key, host, path, rule, verdict, score (null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).select("key", F.coalesce("url", F.lit("")).alias("text"), host.alias("host"), path.alias("path"))
    name, verdict = by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"))
    texts = rows.select("text", "ruled").groupBy("text").agg(F.max("ruled").alias("ruled"), F.count("*").alias("n"))
    texts = stage(texts.withColumn("id", F.monotonically_increasing_id()), "urls")  # fixed by the write
    labelled = texts.where(F.col("ruled").isNotNull()).select("text", (F.col("ruled") == "allow").alias("allowed"))
    held = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0
    grams, contexts = (stage(x, "url-model") for x in train(labelled.where(~held)))
    wanted = texts.where(F.col("ruled").isNull() | held)
    scores = stage(score(wanted, grams, contexts, "id").hint("merge").join(wanted, "id"), "url-scores")
    known = scores.where(F.col("ruled").isNotNull()).select("score", (F.col("ruled") == "allow").alias("allowed"))
    threshold = calibrate(known)
    judged = rows.join(scores.where(F.col("ruled").isNull()).select("text", "score").hint("merge"), "text", "left")
    return judged.select(
        F.col("key").alias(key), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score",
    )
