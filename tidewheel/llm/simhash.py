"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within `RADIUS` (3) differing bits are linked. Half the radius
is one bit and a half, so every fingerprint emits all variants within one bit
of itself outside one of three blocks of bits, once for each block, and the
odd bit is met inside the block. For two linked fingerprints f and g some
block b holds

  * none of the differing bits, of which there are at most two, or exactly
    one of them: outside b they differ in at most two bits, so both emit the
    variant between them, and inside b in at most one bit; or
  * all three (equal outside b, three bits apart inside).

Variants are shuffled on (b, value outside b), 132 rows a distinct
fingerprint; a variant that only one fingerprint emits is dropped there.
Those that collide emit the same balls inside the block, which proves the
distance, so no pair needs to be enumerated: each ball links its members to
one of them (a star), which keeps every component and stays linear in the
size of the group. Exact copies share a fingerprint and are folded first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, components, map_batches

RADIUS = 3
SHINGLE = 3
#: (first bit, bits) of the blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash as a signed integer. Words are lower-cased in A-Z only;
    fewer words than a shingle form one; no words give zero."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(s, 42) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, lambda b: {"doc_id": b["doc_id"], "fp": [fingerprint(x) for x in b["text"]]}, f"doc_id {kind}, fp long")


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _mask(first: int, bits: int) -> int:
    return _signed(((1 << bits) - 1) << first)


def _flips(value: Column, first: int, bits: int, most: int) -> Column:
    """Array of struct(w, d): value with at most `most` (1 or 2) of the bits
    from first flipped, and how many are."""
    ones = [1 << (first + k) for k in range(bits)]
    masks = [(0, 0)] + [(_signed(m), 1) for m in ones]
    if most == 2:
        masks += [(_signed(a ^ b), 2) for k, a in enumerate(ones) for b in ones[:k]]
    listed = F.expr("array(" + ", ".join(f"named_struct('m', {m}L, 'd', {d})" for m, d in masks) + ")")
    return F.transform(listed, lambda x: F.struct(value.bitwiseXOR(x["m"]).alias("w"), x["d"].alias("d")))


def _variants(k: int, first: int, bits: int) -> Column:
    """Array of struct(key, same): the fingerprint without block k, with at
    most one of its other bits flipped; same: none is. The block's own bits
    are zero in a key and the lowest two name the block, so that keys of two
    blocks rarely meet."""
    outer = F.col("fp").bitwiseAND(F.lit(~_mask(first, bits))).bitwiseOR(F.lit(_signed((k + 1) << first)))
    masks = [0] + [_signed(1 << p) for p in range(64) if not first <= p < first + bits]
    listed = F.expr("array(" + ", ".join(f"{m}L" for m in masks) + ")")
    return F.transform(listed, lambda m: F.struct(outer.bitwiseXOR(m).alias("key"), (m == 0).alias("same")))


def links(fps: DataFrame) -> DataFrame:
    """Star edges (a, b) that connect what RADIUS links, from the distinct
    column fp of fps."""
    sets = [_variants(k, first, bits) for k, (first, bits) in enumerate(BLOCKS)]
    rows = fps.select("fp", F.posexplode(F.array(*sets)).alias("block", "variants")).select("fp", "block", F.explode("variants").alias("v"))
    rows = rows.select("fp", F.col("v.key").alias("key"), F.when(F.col("v.same"), -1 - F.col("block")).otherwise(F.col("block")).cast("byte").alias("tag"))
    met = Window.partitionBy("key")
    rows = rows.withColumn("lo", F.min("fp").over(met)).withColumn("hi", F.max("fp").over(met)).where("lo < hi")
    block, same = F.when(F.col("tag") < 0, -1 - F.col("tag")).otherwise(F.col("tag")), F.col("tag") < 0
    one, three = F.lit(None), F.lit(None)
    for k, (first, bits) in enumerate(BLOCKS):
        inside = F.col("fp").bitwiseAND(F.lit(_mask(first, bits)))
        one = F.when(block == k, _flips(inside, first, bits, 1)).otherwise(one)
        three = F.when(block == k, _flips(inside, first, bits, 2)).otherwise(three)
    # Kind 0: outside within two bits, inside one. Kind 1: equal outside, inside three (one from one side, two from the other).
    near = rows.select("fp", "key", block.alias("block"), F.lit(0).alias("kind"), F.explode(one).alias("x"), F.col("x.d").alias("d"))
    far = rows.where(same).select("fp", "key", block.alias("block"), F.lit(1).alias("kind"), F.explode(three).alias("x"), F.greatest(F.lit(0), F.col("x.d") - 1).alias("d"))
    ball = near.union(far).select("fp", "key", "block", "kind", F.col("x.w").alias("w"), "d")
    same_ball = Window.partitionBy("key", "block", "kind", "w")
    hub = ball.withColumn("hub", F.min(F.when(F.col("d") == 0, F.col("fp"))).over(same_ball))
    found = hub.where("hub is not null and hub <> fp").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return found.distinct()


def _rooted(fps: DataFrame) -> DataFrame:
    """(fp, root) of each different fingerprint; root names its component."""
    held = checkpoint(fps.select("fp").distinct())
    comps = components(links(held))
    return held.join(comps, held.fp == comps.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row (doc_id, fp, component_id) for each input row; component_id is
    the least doc_id that links reach. Null and empty texts share fingerprint
    zero; long texts are used whole. Rows without a doc_id keep a fingerprint
    and take no part in components (component_id null); repeated rows come
    back as often as they are given; an empty table gives none."""
    fps = checkpoint(fingerprints(docs, text, id_col))
    held = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = held.join(_rooted(fps.where("doc_id is not null")), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    out = fps.join(named, fps.fp == named.of, "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays, with all of its columns, whatever
    their names: the one with the least doc_id, rows without one last; of
    those alike, the one whose text has the least hash. Null and empty texts
    are alike."""
    at = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), F.xxhash64("content").alias("of"))
    fps = checkpoint(map_batches(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("content")), lambda b: b | {"fp": [fingerprint(x) for x in b["content"]]}, "id long, content string, fp long").select("fp", at.alias("at")))
    rooted = _rooted(fps)
    first = fps.groupBy("fp").agg(F.min("at").alias("at")).join(rooted, "fp").groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.*"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("content"))
    stay = first.select(F.col("none").alias("w_none"), F.col("id").alias("w_id"), F.col("of").alias("w_of"))
    kept = packed.select("row", at.alias("at")).join(stay, (F.col("at.none") == F.col("w_none")) & (F.col("at.id") == F.col("w_id")) & (F.col("at.of") == F.col("w_of")))
    # Rows that are alike in id and text fall together; they are copies of one document.
    again = Window.partitionBy("at").orderBy(F.xxhash64(F.struct("row.*")))
    return kept.withColumn("nth", F.row_number().over(again)).where("nth = 1").select("row.*")
