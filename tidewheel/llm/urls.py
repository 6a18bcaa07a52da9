"""URL filter by a character language-model ratio.

Two variable-order Markov models, of accepted and of rejected URLs, give each
character of a URL's host and path a probability after the up to ORDER
characters before it; each order is smoothed by the next shorter one
(Witten-Bell). The mean log-likelihood ratio of a URL, compared with a
calibrated limit, is the verdict where no rule fits.

Examples: URLs whose host has a word of SUSPECT between separators are the
rejected ones, all others the accepted ones; each different host with path
counts once. Accepted hosts are dealt into two halves by hash, and each half is
scored by what the other one and all rejected examples teach, so that no URL
vouches for itself. The limit is what all but 1 - KEEP of the accepted URLs
stay under, and never below even odds. So a host without a word of the list is
rejected where its characters read more like rejected hosts than those of
nearly all others do.

The model is a table with a row for each context and character that occurs,
in Unicode, so it grows with the URLs and is looked up by a join; only the
number of characters and the limit come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint

#: Rules (host, path, allowed).
RULES = (("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True), ("net", "/es/", False), ("net", "/fr/", False))
#: Words that mark a host as an example of rejected ones.
SUSPECT = ("spam", "casino", "pills", "bets", "betting", "porn", "xxx", "viagra", "poker", "ads", "adserver", "loans", "malware", "phishing")
#: Characters of context at most.
ORDER = 5
#: Share of the accepted examples that the limit keeps.
KEEP = 0.98
#: Stands before the first character.
START = "\u0002"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path of a URL; both empty without one."""
    text = F.coalesce(url, F.lit(""))
    found = F.instr(text, "://")
    rest = F.when(found > 0, F.substring(text, found + 3, F.lit(2147483647))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower, path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, bool], ...] = RULES) -> tuple[Column, Column]:
    """(rule, allowed) of the longest rule that fits; null where none does. A
    rule fits its host and all subdomains, if the path starts with its path."""
    name = allowed = F.lit(None)
    for h, p, ok in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, allowed = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(ok)).otherwise(allowed)
    return name.cast("string"), allowed.cast("boolean")


def is_suspect(host: Column, words: tuple[str, ...] = SUSPECT) -> Column:
    return F.coalesce(host.rlike(r"(?:^|[.-])(?:" + "|".join(words) + r")(?:$|[.-])"), F.lit(False))


def half(host: Column) -> Column:
    return (F.crc32(host.cast("binary")) % 2).cast("int")


def grams(text: Column) -> Column:
    """Array of each character of a text with the ORDER characters before it."""
    chars = F.split(F.concat(F.lit(START * ORDER), F.lower(text)), "")
    each = F.transform(F.sequence(F.lit(1), F.length(F.lower(text))), lambda i: F.array_join(F.slice(chars, i, ORDER + 1), ""))
    return F.when(F.length(text) > 0, each).otherwise(F.array().cast("array<string>"))


def counts(urls: DataFrame) -> DataFrame:
    """(gram, yes0, yes1, no): how often each gram is in the accepted examples
    of both halves and in rejected examples, from (text, suspect, half)."""
    rows = urls.select("suspect", "half", F.explode(grams(F.col("text"))).alias("gram"))
    times = lambda c: F.count(F.when(c, 1))
    yes = [times(~F.col("suspect") & (F.col("half") == k)).alias(f"yes{k}") for k in (0, 1)]
    return rows.groupBy("gram").agg(*yes, times(F.col("suspect")).alias("no"))


def ratios(found: DataFrame, size: int) -> DataFrame:
    """(gram, ratio0, ratio1): the log-likelihood ratio, rejected over
    accepted, of each gram's last character after those before it, for each
    half by what the other one teaches. From the empty context to ORDER
    characters, a context's counts are smoothed by the next shorter one,
    weighted with the number of different characters that follow it
    (Witten-Bell); below the empty one all `size` characters are even."""
    sides = ("yes0", "yes1", "no")
    shorter = None
    for n in range(ORDER + 1):
        key = F.substring("gram", ORDER + 1 - n, n + 1)
        here = found.groupBy(key.alias("gram")).agg(*[F.sum(c).alias(c) for c in sides])
        context = Window.partitionBy(F.substring("gram", 1, n))
        here = here.select("gram", *sides, *[f(c).over(context).alias(f"{k}_{c}") for c in sides for k, f in (("all", F.sum), ("kinds", lambda x: F.sum((F.col(x) > 0).cast("long"))))])
        if shorter is None:
            here = here.withColumns({f"p_{c}": F.lit(1.0 / size) for c in sides})
        else:
            here = here.withColumn("tail", F.substring("gram", 2, n)).join(shorter, "tail")
        p = [F.when(F.col(f"all_{c}") > 0, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"p_{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c in sides]
        shorter = here.select(F.col("gram").alias("tail"), *p)
    return shorter.select(F.col("tail").alias("gram"), *[F.log(F.col("p_no") / F.col(f"p_yes{1 - k}")).alias(f"ratio{k}") for k in (0, 1)])


def scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(text, suspect, score): the mean ratio of the characters of each text.
    Frequent grams meet the model in a join that adaptive execution can split;
    the texts are told apart by a hash until their sums are made."""
    of = F.xxhash64("text", F.length("text")).alias("of")
    rows = urls.select(of, "half", F.explode(grams(F.col("text"))).alias("gram")).join(model, "gram")
    sums = rows.groupBy("of").agg(F.avg(F.when(F.col("half") == 0, F.col("ratio0")).otherwise(F.col("ratio1"))).alias("score"))
    return urls.select("text", "suspect", of).join(sums, "of", "left").select("text", "suspect", F.coalesce("score", F.lit(0.0)).alias("score"))


def limit_of(scored: DataFrame) -> float | None:
    """What a score may not exceed; None (nothing is rejected) without
    rejected examples."""
    s = scored.agg(F.max(F.col("suspect").cast("int")).alias("any"), F.percentile_approx(F.when(~F.col("suspect"), F.col("score")), KEEP, 10000).alias("top")).first()
    return max(0.0, s["top"] or 0.0) if s["any"] else None


def judge(pages: DataFrame, url: str = "url", id_col: str = "page_id", rules: tuple[tuple[str, str, bool], ...] = RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule (or null), score (mean
    log-likelihood ratio) and verdict. A null URL, or one without "://", has
    empty host and path, fits no rule, scores 0 and is allowed, as an empty
    one is. Long URLs are used whole; rows may repeat, with and without the
    same id, and come back as often; pages with one host and path have one
    score. An empty table gives no rows."""
    host, path = host_path(F.col(url))
    name, allowed = rule_of(F.col("host"), F.col("path"), rules)
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = parts.select("page_id", "host", "path", name.alias("rule"), allowed.alias("allowed"), F.concat("host", "path").alias("text"))
    texts = parts.groupBy(F.concat("host", "path").alias("text")).agg(F.min("host").alias("host"))
    suspect = is_suspect(F.col("host"))
    texts = checkpoint(texts.select("text", suspect.alias("suspect"), half(F.col("host")).alias("half")))
    dealt = texts.where("not suspect").agg(F.min("half").alias("low"), F.max("half").alias("high")).first()
    found = counts(texts)
    if dealt["low"] == dealt["high"]:  # one host, say: there is no other half to learn from
        found = found.withColumns({"yes0": F.col("yes0") + F.col("yes1"), "yes1": F.col("yes0") + F.col("yes1")})
    found = checkpoint(found)  # used by every order
    size = found.select(F.substring("gram", ORDER + 1, 1).alias("c")).distinct().count()
    scored = checkpoint(scores(texts, ratios(found, max(1, size))))
    limit = limit_of(scored)
    ok = F.coalesce("allowed", F.col("score") <= F.lit(limit), F.lit(True))
    out = rows.join(scored.select("text", "score"), "text")
    return out.select("page_id", "host", "path", "rule", "score", F.when(ok, "allow").otherwise("block").alias("verdict"))
