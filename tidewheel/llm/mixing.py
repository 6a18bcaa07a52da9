"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its weighted share of all words, at most three times
what it has; what is over goes to the others by weight. Within a source each
document has its own expected number of copies, which grows with its size: the
source's rate (target over size), raised or lowered by up to PULL as its size
over size plus HALF is above or below the source's mean, so that the expected
words are the target and no document expects more than `most` copies. The
whole part is allocated for certain. The fraction is the document's inclusion
probability: documents are ranked by their random odds over their inclusion
odds (Rosen, "On sampling with probability proportional to size", 1997), and
the first ones that together come nearest to the missing words are taken once
more. Random numbers derive from the document's id and size, so that reruns
agree.

No source, however large, is sorted in one task: the words of each source are
summed in LEVEL bins of the rank, only the bin in which the count is reached
is split again, and only the documents of one of its bins are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpoint

WEIGHTS = (1, 2, 3)
MOST = 3
#: How far sizes pull the copies of a document at most, and the size that pulls half.
PULL, HALF = 0.5, 256
#: Steps of the pull: whole numbers, so that sums are exact.
STEPS = 100
LEVEL = 4096
#: Facts of this many sources at most are broadcast (under 1 MB); of more, they are joined over SALTS keys a source.
FEW_SOURCES = 10_000
SALTS = 32
_UNIT = 1 << 52


def word_count(text: str) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size, ...), one row a source, with target, which
    is min(most * size, c * weight) with the c that shares out all words."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("nth", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    listed = listed.withColumn("weight", weight.cast("long"))
    # c is the largest of what each source, with all of lower ratio at their limit, would give a unit of weight.
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "nth")
    every, up = ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), ratio.rowsBetween(Window.unboundedPreceding, -1)
    full = F.sum("source_size").over(every)
    limited = F.coalesce(F.sum(F.col("source_size") * most).over(up), F.lit(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0))
    shared = listed.withColumn("unit", (full - limited).cast("double") / left.cast("double"))
    shared = shared.withColumn("unit", F.max("unit").over(every))
    limit, wanted = (F.col("source_size") * most).cast("double"), F.col("unit") * F.col("weight")
    return shared.withColumn("target", F.least(limit, wanted)).select(*sources.columns, "target")


def pull(size: Column) -> Column:
    """0 to STEPS - 1, growing with the size."""
    return F.floor(size * STEPS / (size + HALF)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, u): u is uniform in (0, 1)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string")).cast("binary"))
    return rows.withColumn("u", (F.conv(F.substring(key, 1, 13), 16, 10).cast("long") + 0.5) / float(_UNIT))


def _with_source(rows: DataFrame, facts: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows joined to one row of facts for each source (of). A source may hold
    a third of all rows: few facts are broadcast; of many sources, rows are
    dealt over SALTS keys each, and the facts repeated under each."""
    if few:
        return rows.join(F.broadcast(facts), "of", how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["of", "salt"], how).drop("salt")


def allocate(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row
    of sizes(). Rows without an id or source take part like others, rows that
    repeat as well; sources without words have target 0; documents without
    words take none; ties of rank are ordered by id and size; an empty table
    gives no rows."""
    of = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(pull(F.col("size")) * F.col("size")).alias("pulled"))
    goals = checkpoint(targets(per_source, weights, most))
    few = goals.count() <= FEW_SOURCES
    full = goals.where("source_size > 0").withColumn("rate", F.col("target") / F.col("source_size")).withColumn("mean", F.col("pulled").cast("double") / F.col("source_size").cast("double"))
    full = full.withColumn("reach", F.when(F.col("mean") > 0, F.least(F.lit(PULL), (most / F.col("rate") - 1) / (STEPS / F.col("mean") - 1))).otherwise(F.lit(0.0)))
    wide = goals.select("source", "source_size", "target").join(full.select(F.col("source").alias("s"), "rate", "mean", "reach"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    facts = wide.select(of.alias("of"), "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("reach", F.lit(0.0)).alias("reach"))
    each = _with_source(rows.withColumn("of", of), facts, few)
    expected = F.when(F.col("reach") > 0, F.col("rate") * (1 + F.col("reach") * (pull(F.col("size")) / F.col("mean") - 1))).otherwise(F.col("rate"))
    each = each.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("whole"))
    # The rank grows with the odds and lies in (0, 1); without a chance it is 1, the last.
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = each.withColumn("odds", F.when(F.col("p") > 0, odds)).withColumn("rank", F.coalesce(F.col("odds") / (1 + F.col("odds")), F.lit(1.0)))
    bin1 = F.least(F.floor(F.col("rank") * LEVEL), F.lit(LEVEL - 1))
    ranked = ranked.withColumn("b1", bin1).withColumn("b2", F.least(F.floor((F.col("rank") * LEVEL - bin1) * LEVEL), F.lit(LEVEL - 1)))
    ranked = checkpoint(ranked.select("of", "doc_id", "source", "size", "source_size", "target", "whole", "rank", "b1", "b2"))
    certain = ranked.groupBy("of").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("goal"))
    rests = checkpoint(certain.select("of", F.greatest(F.lit(0.0), F.col("goal") - F.col("certain")).alias("rest")))

    def reached(part: DataFrame, name: str, before: Column) -> DataFrame:
        """The bin of each source in which its rest is reached, and the words
        before it: (of, name_at, name_before)."""
        sums = part.groupBy("of", name).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first(before).alias("start"))
        upto = sums.withColumn("upto", F.col("start") + F.sum("n").over(Window.partitionBy("of").orderBy(name)))
        return upto.where("upto > rest and upto - n < rest").select("of", F.col(name).alias(f"{name}_at"), (F.col("upto") - F.col("n")).alias(f"{name}_before"))

    binned = _with_source(ranked.groupBy("of", "b1").agg(F.sum("size").alias("size")).withColumn("doc_id", F.col("b1")), rests.where("rest > 0"), few)
    first = checkpoint(reached(binned, "b1", F.lit(0).cast("long")).join(rests, "of"))
    inside = _with_source(ranked, first, few).where("b1 = b1_at")
    second = checkpoint(reached(inside, "b2", F.col("b1_before")))
    edge = rests.join(first.drop("rest"), "of", "left").join(second, "of", "left").select("of", "rest", "b1_at", "b2_at", "b2_before")
    joined = _with_source(ranked, edge, few, "left")
    # Only the documents of the last bin are ordered; a source has about 1 / LEVEL^2 of its documents there.
    last = F.coalesce((F.col("b1") == F.col("b1_at")) & (F.col("b2") == F.col("b2_at")), F.lit(False))
    nth = Window.partitionBy("of").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ordered = joined.where(last).withColumn("upto", F.col("b2_before") + F.sum("size").over(nth))
    ordered = ordered.withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("upto")
    below = F.when(F.col("rest") <= 0, 0).when(F.col("b1_at").isNull(), 1).when(F.col("b1") != F.col("b1_at"), (F.col("b1") < F.col("b1_at")).cast("int")).when(F.col("b2_at").isNull(), 1).otherwise((F.col("b2") < F.col("b2_at")).cast("int"))
    others = joined.where(~last).withColumn("more", F.when(F.col("rank") < 1, below).otherwise(0).cast("long"))
    out = ordered.withColumn("more", F.when(F.col("rank") < 1, F.col("more")).otherwise(0).cast("long")).unionByName(others).withColumn("copies", F.col("whole") + F.col("more"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """allocate() of all documents, long texts whole; a null text has no words."""
    return allocate(checkpoint(sizes(docs)), weights, most)


def repeat_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as many times as the mix takes it; all columns stay,
    whatever their names. Rows alike in id, source and size share the copies
    of their group: the first ones have one more where they don't divide."""
    taken = mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = taken.where("copies > 0").select(*[F.col(c).alias(f"of_{c}") for c in ("doc_id", "source", "size")], "copies", "rows")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("src"), word_count("text").alias("words"))
    joined = packed.join(taken, F.col("id").eqNullSafe(F.col("of_doc_id")) & F.col("src").eqNullSafe(F.col("of_source")) & (F.col("words") == F.col("of_size")))
    nth = F.row_number().over(Window.partitionBy("id", "src", "words").orderBy(F.xxhash64("row.text")))
    alike = joined.where("rows > 1").withColumn("nth", nth).withColumn("times", F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") <= F.col("copies") % F.col("rows")).cast("long")).drop("nth")
    each = joined.where("rows = 1").withColumn("times", F.col("copies")).unionByName(alike).where("times > 0")
    return each.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")


ORACLE = f"""
with d as (select doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[^w]', '', 'g')), 0)::bigint as size from documents),
k as (select *, ((('0x' || substr(md5(concat_ws(':', doc_id::varchar, size::varchar)), 1, 13))::bigint) + 0.5::double) / {_UNIT}::double as u from d),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight, row_number() over (order by source nulls last) as nth from s),
c as (select *, ((sum(source_size) over () - coalesce(sum(source_size * 3) over r, 0))::double / (sum(weight) over () - coalesce(sum(weight) over r, 0))::double) as unit0
      from n window r as (order by source_size::double / weight::double, nth rows between unbounded preceding and 1 preceding)),
t as (select *, least((source_size * 3)::double, max(unit0) over () * weight) as target from c),
w as (select source, sum(floor(size * {STEPS} / (size + {HALF}))::bigint * size)::bigint as pulled from d group by source),
f as (select t.*, t.target / t.source_size as rate, pulled::double / source_size::double as mean from t join w on t.source is not distinct from w.source),
g as (select *, case when source_size > 0 and mean > 0 then least({PULL}::double, (3 / rate - 1) / ({STEPS} / mean - 1)) else 0.0::double end as reach from f),
e as (select k.*, g.source_size, g.target, case when g.source_size = 0 then 0.0::double when reach > 0 then rate * (1 + reach * (floor(size * {STEPS} / (size + {HALF}))::bigint / mean - 1)) else rate end as expected
      from k join g on k.source is not distinct from g.source),
h as (select *, floor(expected)::bigint as whole, expected - floor(expected)::bigint as p from e),
j as (select *, greatest(0.0::double, target - sum(whole * size) over (partition by source)::double) as rest, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as odds from h),
o as (select *, sum(size) over (partition by source order by coalesce(odds / (1 + odds), 1.0::double), doc_id, size rows unbounded preceding) as upto from j)
select doc_id, size, source_size, target, (size * (whole + case when rest > 0 and p > 0 and upto - size / 2.0::double <= rest then 1 else 0 end))::bigint as taken from o
"""
