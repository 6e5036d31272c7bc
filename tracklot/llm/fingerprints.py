"""Document fingerprints from closed syncmers (Edgar 2021), in DataFrame functions only.

A text's k-mers are runs of ``K`` words. A k-mer is chosen when the least of its inner hashes, over runs of ``S`` words,
is its first or its last: a rule that looks at nothing outside the k-mer, so equal passages choose equal k-mers wherever
they stand. The rule alone sets the density, two in ``K - S + 1``, and at least one of any ``K - S`` neighbours is chosen.
A fingerprint holds every chosen k-mer with its place in words. Two fingerprints are matched by position: shared anchors
count if they are shifted alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklot.llm.common import order_bounds, shuffle_width, table, with_order_bucket

K, S = 6, 2
#: An anchor is one number: 37 bits of hash, one that is set while two fingerprints are merged, 26 of place.
PLACE_BITS = 26
#: Words by which a shared anchor's shift may differ from the median shift.
DRIFT = 16
#: Documents of a bucket in the pass that pairs neighbours.
BUCKET_ROWS = 4_000
_SPACES = r"[\\x20\\x09-\\x0D]+"
_INNER = [f"{{g}}[i + {j}]" for j in range(K - S + 1)]
_PLACE = f"{(1 << PLACE_BITS) - 1}L"


def with_anchors(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add, per text column, its anchors by place. A text without any is one anchor by all its words; one without words has none."""
    for step, expr in (
        ("h", f"transform(filter(split({{text}}, '{_SPACES}'), w -> w <> ''), w -> xxhash64(w))"),
        ("g", "transform(slice({h}, 2, greatest(size({h}) - 1, 0)), (x, i) -> xxhash64({h}[i], x))"),
        ("at", f"filter(sequence(0, size({{g}})), i -> i <= size({{g}}) - {len(_INNER)} AND least({', '.join(_INNER)}) IN ({_INNER[0]}, {_INNER[-1]}))"),
        ("out", f"CASE WHEN size({{at}}) > 0 THEN transform({{at}}, i -> shiftleft(xxhash64({', '.join(_INNER[::S])}), {PLACE_BITS + 1}) | least(cast(i AS bigint), {_PLACE})) WHEN size({{h}}) > 0 THEN array(shiftleft(xxhash64({{h}}), {PLACE_BITS + 1})) ELSE cast(array() AS array<bigint>) END"),
    ):
        names = {c: {s: f"_{c}_{s}" for s in ("h", "g", "at", "out")} | {"text": c} for c in columns}
        df = df.withColumns({names[c][step]: F.expr(expr.format(**names[c])) for c in columns})
    drop = [f"_{c}_{s}" for c in columns for s in ("h", "g", "at")]
    return df.drop(*drop).withColumnsRenamed({f"_{c}_out": out for c, out in columns.items()})


def written(anchors: str) -> Column:
    """A fingerprint's text: hash in hexadecimal, colon, place; by place."""
    return F.expr(f"array_join(transform({anchors}, x -> concat(lower(hex(shiftrightunsigned(x, {PLACE_BITS + 1}))), ':', x & {_PLACE})), ',')")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Share of both fingerprints' hashes that both have, shifted alike (a repeated hash at its first place); 1 for two empty ones."""
    m, both, shift, mid = (f"_{out}_{s}" for s in ("m", "both", "shift", "mid"))
    side, top = f"{1 << PLACE_BITS}L", PLACE_BITS + 1
    df = df.withColumn(m, F.expr(f"sort_array(concat({a}, transform({b}, x -> x | {side})))"))
    df = df.withColumn(m, F.expr(f"filter({m}, (x, i) -> i = 0 OR shiftright({m}[i - 1], {PLACE_BITS}) <> shiftright(x, {PLACE_BITS}))"))
    df = df.withColumn(both, F.expr(f"filter(transform({m}, (x, i) -> IF(i > 0 AND shiftright({m}[greatest(i - 1, 0)], {top}) = shiftright(x, {top}), ({m}[greatest(i - 1, 0)] & {_PLACE}) - (x & {_PLACE}), NULL)), s -> s IS NOT NULL)"))
    df = df.withColumn(shift, F.expr(f"sort_array({both})")).withColumn(mid, F.expr(f"get({shift}, cast(size({shift}) div 2 AS int))"))
    alike = F.expr(f"size(filter({shift}, s -> abs(s - {mid}) <= {DRIFT})) / (size({m}) - size({shift}))")
    return df.withColumn(out, F.when(F.size(m) == 0, F.lit(1.0)).otherwise(alike).cast("double")).drop(m, both, shift, mid)


def with_next(df: DataFrame, rows_per_bucket: int = BUCKET_ROWS) -> tuple[DataFrame, Window]:
    """Rows dealt into consecutive buckets of (doc_id, text hash), each with the first row of the next bucket at its end (``extra``), and the window that walks a bucket.

    The last bucket ends with the first row of all.
    """
    keyed = df.withColumn("text_hash", F.xxhash64("text"))
    bounds = order_bounds(keyed, ["doc_id", "text_hash"], rows_per_bucket)
    dealt = with_order_bucket(keyed, ["doc_id", "text_hash"], bounds)
    places = F.when(F.col("opens"), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra")), F.struct(F.pmod(F.col("bucket") - 1, F.lit(max(1, len(bounds)))).alias("bucket"), F.lit(1).alias("extra"))))
    places = places.otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra"))))
    out = dealt.select(*[c for c in keyed.columns], F.explode(places).alias("place")).select(*keyed.columns, "place.bucket", "place.extra")
    out = out.repartition(shuffle_width(df), "bucket")  # as many partitions as the input asks for
    return out, Window.partitionBy("bucket").orderBy("extra", "doc_id", "text_hash")


def fingerprints(docs: DataFrame, rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likenesses (doc_id, text; other columns are ignored).

    The edited text has the last half of its code points (rounded down) replaced by the first as many of the next
    document's, by ascending doc_id (null first), the first after the last. A null text is empty. Rows that repeat a
    doc_id follow each other by the hash of their texts. An empty table gives no rows. Texts move once, to sit beside
    their neighbour.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt, walk = with_next(rows, rows_per_bucket)
    paired = dealt.withColumn("next", F.lead("text").over(walk)).withColumn("n_chars", F.length("text"))
    edited = F.concat(F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 2) AS int))"), F.expr("substring(coalesce(next, ''), 1, cast(floor(n_chars / 2) AS int))"))
    paired = paired.withColumn("edited", edited).drop("next").withColumn("edited_sha256", F.sha2("edited", 256))
    marked = with_anchors(paired, {"text": "own", "edited": "changed"}).drop("text", "edited")
    marked = marked.withColumn("after", F.lead("own").over(walk)).where("extra = 0")
    near = with_likeness(with_likeness(marked, "own", "changed", "near_edited"), "own", "after", "near_next")
    return near.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", written("own").alias("fingerprint"), written("changed").alias("edited_fingerprint"), "near_edited", "near_next")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
