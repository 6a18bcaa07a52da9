"""SpotSigs document fingerprints, with DataFrame functions only.

A signature is a common word (the anchor) with the chain of CHAIN content
words that follow it, common words skipped (Theobald et al., "SpotSigs", 2008).
Common words are ANCHORS, in four languages, and all words of one or two
letters. The fingerprint is the set of a text's signatures, hashed to 32 bits;
two are compared by their Jaccard similarity. Sets are partitioned by length:
sets that reach a similarity t have lengths within a factor 1 / t, so pairs
whose partitions are further apart are pruned without a look at the sets.

A signature that occurs n times counts n times. The start of a text is an
anchor too, of its first content words and of the first one alone; a chain
that the end of the text cuts short counts as it is; one signature is that of
the whole text; and in a text of common words alone, all are content. So texts
of any length and kind have signatures by one and the same rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint

CHAIN = 2
#: Common words: English, German, French, Spanish.
ANCHORS = tuple(
    """
    the and for are but not you all any can had her was one our out has his how its may new now see two who did
    that with have this will your from they know want been good much some time when them than were what which their there would about other into only then also these those such
    der die das und ist nicht von mit den dem des ein eine einer einen auf für sich als auch aus bei nach wie wird sind oder aber zum zur über durch nur noch vor
    les une des est pas que qui dans pour sur par plus avec son ses aux cette sont mais nous vous leur elle comme tout ces être entre sans
    los las una del que por con para como más pero sus entre sobre este esta también cuando todo desde muy sin hay ser son fue han
    """.split()
)
#: More than the error of a product or logarithm, less than any step of theirs.
ROUNDING = 1e-9
#: Rows of this many neighbouring ids, at most, are put in order together.
BUCKET_BITS = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _common(word: Column) -> Column:
    return (F.length(word) <= 2) | word.isin(*ANCHORS)


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(0xFFFFFFFF))


def signatures(text: Column) -> Column:
    """32-bit signatures, ascending, as an array of bigint; empty for an empty
    or null text. Texts without letters and digits have one, of their own."""

    def chain(content: Column, anchor: Column, k: Column) -> Column:
        """The signature of an anchor that k content words lie before."""
        return F.when(k < F.size(content), _hash(anchor, F.array_join(F.slice(content, k + 1, CHAIN), " ")))

    def common(words: Column) -> Column:
        content = F.filter(words, lambda w: ~_common(w))
        at = F.filter(F.transform(words, lambda w, i: F.when(_common(w), i)), lambda i: i.isNotNull())
        # k anchors come before the k-th, at position i: i - k content words do.
        return _let(content, lambda c: F.transform(at, lambda i, k: chain(c, F.get(words, i), i - k)))

    def first(content: Column) -> Column:
        return F.array(chain(content, F.lit(""), F.lit(0)), _hash(F.lit(""), F.get(content, 0)))

    def numbered(s: Column) -> Column:
        """A sorted array with the n-th of equal values hashed with n."""
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())

        def runs(b: Column) -> Column:
            end = lambda k: F.coalesce(F.get(b, k + 1), F.size(s))
            again = lambda i, k: F.transform(F.sequence(F.lit(0), end(k) - i - 1), lambda n: F.when(n == 0, F.get(s, i)).otherwise(_hash(F.get(s, i), n)))
            return F.flatten(F.transform(b, again))

        return _let(starts, runs)

    def of(plain: Column) -> Column:
        def spotted(w: Column) -> Column:
            content = F.filter(w, lambda x: ~_common(x))
            return F.concat(common(w), _let(content, lambda c: first(F.when(F.size(c) > 0, c).otherwise(w))), F.array(_hash(plain)))

        bare = F.when(F.length(text) > 0, F.array(_hash(text))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.length(plain) == 0, bare).otherwise(F.array_compact(_let(F.split(plain, " "), spotted)))

    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.array_sort(F.array_distinct(_let(F.array_sort(_let(plain, of)), numbered)))


def fingerprint(sigs: Column) -> Column:
    """The set as text: eight hexadecimal digits a signature."""
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def partition(sigs: Column, threshold: float) -> Column:
    """Length partition: similar sets lie in the same or neighbouring ones."""
    # What is added keeps exact powers, which sizes can be, on their side of the bound.
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1)).cast("double")) / -math.log(threshold) + ROUNDING)


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity, 1 for two empty sets; with a threshold, 0 for pairs
    that the length partitions or lengths alone show to stay below it."""
    both = F.size(F.array_intersect(a, b))
    exact = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(_let(both, lambda n: n / (F.size(a) + F.size(b) - n)))
    if threshold <= 0:
        return exact
    far = (F.abs(partition(a, threshold) - partition(b, threshold)) > 1) | (F.least(F.size(a), F.size(b)) < threshold * F.greatest(F.size(a), F.size(b)) - ROUNDING)
    return F.when(far, 0.0).otherwise(exact)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): the row after each in
    descending doc_id, the first after the last. No task orders more than the
    rows of one bucket of ids, or one part of the bucket numbers."""
    # The filter is what the joins below imply; said here, both uses of the shuffled texts are the same and one is made.
    rows = docs.withColumn("bucket", F.shiftright("doc_id", BUCKET_BITS)).where("bucket is not null")
    numbers = rows.select("bucket").distinct().repartitionByRange("bucket")
    numbers = checkpoint(numbers.withColumn("part", F.spark_partition_id()))
    heads = numbers.groupBy("part").agg(F.max("bucket").alias("head"))  # a row for each partition
    all_parts = Window.orderBy("part")
    lower = heads.withColumn("lower", F.coalesce(F.lag("head").over(all_parts), F.max("head").over(all_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    within = Window.partitionBy("part").orderBy(F.desc("bucket"))
    after = numbers.withColumn("inner", F.lead("bucket").over(within)).join(lower, "part").select("bucket", F.coalesce("inner", "lower").alias("next_bucket"))

    dealt = rows.repartition("bucket")
    order = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), "text")
    first = dealt.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("head_text"))
    first = first.withColumn("head_sigs", signatures(F.col("head_text")))
    first = after.join(first, "next_bucket").select(F.col("bucket").alias("of"), "head_text", "head_sigs")
    signed = dealt.withColumn("sigs", signatures(F.col("text")))
    led = signed.select("*", F.lead("text").over(order).alias("led_text"), F.lead("sigs").over(order).alias("led_sigs"), F.lead(F.lit(True)).over(order).isNull().alias("last"))
    joined = led.join(first, (F.col("bucket") == F.col("of")) & F.col("last"), "left")
    pick = lambda k: F.when(F.col("last"), F.col(f"head_{k}")).otherwise(F.col(f"led_{k}")).alias(f"next_{k}")
    return joined.select("doc_id", "text", "sigs", pick("text"), pick("sigs"))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_sigs, fingerprint) of every row, in one narrow step."""
    rows = docs.select(F.col(id_col).alias("doc_id"), signatures(F.col(text)).alias("sigs"))
    return rows.select("doc_id", F.size("sigs").alias("n_sigs"), fingerprint(F.col("sigs")).alias("fingerprint"))


def similar(docs: DataFrame, threshold: float = 0.8, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members(doc_id, class_id) puts every row with an id
    into the class of texts that have the same signatures, named after its
    least id; pairs(a, b, likeness) are all pairs of classes, a < b, whose sets
    are alike to threshold or more, which is above 0 and at most 1.

    Sets meet by their rarest signatures: of two sets of Jaccard similarity t,
    ordered alike, the first |s| - ceil(t |s|) + 1 signatures of each share
    one. They meet within a length partition or between neighbouring ones, and
    a pair goes on to the comparison of sets only if its lengths and what
    follows the shared signatures leave room for t. Rows meet by joins, which
    are split where a signature is frequent, and no group is ever gathered;
    copies are folded before. Null texts count as empty ones, which are a
    class of their own without pairs; long texts are used whole; repeated rows
    are members of one class, a row each. An empty table gives no rows."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    rows = docs.select(F.col(id_col).alias("doc_id"), signatures(F.col(text)).alias("sigs")).where("doc_id is not null")
    rows = checkpoint(rows.withColumn("of", F.sha2(fingerprint(F.col("sigs")), 256)))
    classes = rows.groupBy("of").agg(F.min("doc_id").alias("class_id"))
    members = rows.select("doc_id", "of").join(classes, "of").select("doc_id", "class_id")
    # A row of each class, by its digest and least id; equal rows are one.
    sets = rows.join(classes.select("of", F.col("class_id").alias("doc_id")), ["of", "doc_id"], "left_semi").dropDuplicates(["of", "doc_id"])
    sets = checkpoint(sets.where(F.size("sigs") > 0).select(F.col("doc_id").alias("id"), "sigs"))
    if threshold == 1:
        return members, sets.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("likeness")).where(F.lit(False))

    each = sets.select("id", F.size("sigs").alias("n"), partition(F.col("sigs"), threshold).alias("part"), F.explode("sigs").alias("sig"))
    known = each.groupBy("sig").agg(F.count("*").alias("times"))
    order = F.array_sort(F.collect_list(F.struct("times", "sig")))
    n = F.col("n")
    first = F.slice(F.col("rarest"), 1, (n - F.ceil(n * threshold - ROUNDING) + 1).cast("int"))
    ranked = each.join(known, "sig").groupBy("id", "n", "part").agg(order.alias("rarest"))
    probes = checkpoint(ranked.select("id", "n", "part", F.posexplode(F.transform(first, lambda s: s["sig"])).alias("at", "sig")))

    left = probes.select("sig", "part", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    met = F.explode(F.array(F.col("part"), F.col("part") - 1))
    right = probes.select("sig", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("part").alias("own"), met.alias("part"))
    once = (F.col("own") > F.col("part")) | (F.col("a") < F.col("b"))
    # The first signature that two sets share leaves room for all the others; a later one has less room, but then the first was met too.
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - ROUNDING) & (room >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - ROUNDING)
    found = left.join(right, ["sig", "part"]).where(once & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda k: sets.select(F.col("id").alias(k), F.col("sigs").alias(f"sigs_{k}"))
    compared = found.join(of("a"), "a").join(of("b"), "b").select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b"), threshold).alias("likeness"))
    return members, compared.where(F.col("likeness") >= threshold)


def edited_likeness(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: its fingerprint, and that of its edited
    text, whose last third is replaced by the beginning of the next document;
    near_edited and near_next compare with the edited text and with the next
    document. Null texts count as empty ones, whose set is empty; long texts
    are used whole. Rows that repeat an id are ordered by text. Rows without
    an id have no next document: an empty text stands for it and near_next is
    0. An empty table gives no rows."""
    # An alias of a column to its own name would keep Spark from reusing the shuffle in with_next().
    rows = docs.select("doc_id" if id_col == "doc_id" else F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = with_next(rows.where("doc_id is not null"))
    loose = rows.where("doc_id is null").select("doc_id", "text", signatures(F.col("text")).alias("sigs"), F.lit("").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_sigs"))
    out = ordered.union(loose).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    out = out.withColumn("edited", edited)
    # explode() keeps the signatures of the edited text apart, so that they are computed once.
    out = out.select("*", F.explode(F.array(signatures(F.col("edited")))).alias("edited_sigs"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), F.coalesce(likeness(F.col("sigs"), F.col("next_sigs")), F.lit(0.0)).alias("near_next"), F.size("sigs").alias("n_sigs"),
    )
