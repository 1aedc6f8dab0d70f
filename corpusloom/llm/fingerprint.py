"""Document fingerprints by one-permutation MinHash (DataFrame functions only).

The distinct 5-word shingles of a lower-cased text are hashed once; the top bits of a hash choose
one of ``bins`` bins and the least hash of a bin is its value.  An empty bin ``j`` walks the bins
``h(j, 1), h(j, 2), ...`` of a universal hash until it meets a bin that was filled, and copies
it (optimal densification); after ``WALK`` steps, which a text with half its bins filled reaches
once in 256 empty bins, the walk is finished in one go by the least of a further hash over the filled bins:
each of them is met with the same odds, as by walking on.  Only the low ``bits`` bits of each value are stored,
packed as hex.  Two fingerprints agree in a bin by chance with probability ``2**-bits``, which
:func:`likeness` takes out.

Defined results: a null text is empty; a text of fewer than five words has one shingle, its whole
sequence; a text without words has the empty fingerprint, whose likeness is 1 to another empty one
and 0 to all else; documents with equal ids are ordered by the hash of their texts and then the texts,
null ids first; repeated rows follow each other, and where an id has enough of them to fill a range they
are counted first and worked on once, so no task holds them; an empty table gives an empty result; further
columns are ignored.  A very long text must fit a row, with eight bytes for each of its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 128
BITS = 8
SHINGLE = 5
WALK = 8
BUCKET_ROWS = 500
COPIES = 1 << 16  # repeated rows are written out in runs of so many
MAX_BUCKETS = 1 << 16  # so many bounds of id ranges, and as many for null ids, go through the driver


def with_lanes(df: DataFrame, text: str, out: str, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``df`` with ``out``, the array of ``bins`` low-bit values (empty for a text without words)."""
    w, h, s, f, b, p = (f"_{out}_{x}" for x in "whsfbp")
    shift = 64 - (bins.bit_length() - 1)
    near = ", ".join(f"{h}[i + {k}]" for k in range(1, SHINGLE))
    walk = ", ".join(f"nullif({p}[cast(pmod(xxhash64(j, {a}), {bins}) as int)], 0)" for a in range(1, WALK + 1))
    last = f"array_position({b}, array_min(transform({b}, y -> struct(xxhash64(j, y, -1) as r, y as y))).y)"
    plain = f"lower({text})"
    for c in ("\\t", "\\n", "\\u000B", "\\u000C", "\\r"):
        plain = f"replace({plain}, '{c}', ' ')"
    df = df.withColumn(w, F.expr(f"array_remove(split({plain}, ' '), '')"))
    df = df.withColumn(h, F.expr(f"transform({w}, x -> xxhash64(x))")).drop(w)
    df = df.withColumn(s, F.expr(f"sort_array(case when size({h}) >= {SHINGLE} then transform(slice({h}, 1, size({h}) - {SHINGLE - 1}), (x, i) -> xxhash64(x, {near})) when size({h}) > 0 then array(xxhash64({h})) else array() end)")).drop(h)
    df = df.withColumn(f, F.expr(f"filter({s}, (x, i) -> i = 0 or shiftright(x, {shift}) <> shiftright({s}[i - 1], {shift}))")).drop(s)
    df = df.withColumn(b, F.expr(f"transform({f}, x -> cast(shiftright(x, {shift}) + {bins // 2} as int))"))
    df = df.withColumn(p, F.expr(f"transform(sequence(0, {bins - 1}), j -> cast(array_position({b}, j) as int))"))
    low = (1 << bits) - 1
    value = f"{f}[cast(case when q > 0 then q else coalesce({walk}, {last}) end as int) - 1]"
    lanes = f"case when size({f}) = 0 then cast(array() as array<smallint>) when size({f}) = {bins} then transform({f}, x -> cast(x & {low} as smallint)) else transform({p}, (q, j) -> cast({value} & {low} as smallint)) end"
    return df.withColumn(out, F.expr(lanes)).drop(f, b, p)


def packed(lanes: str, bits: int = BITS):
    """The fingerprint string: ``bits`` bits a bin (4 or 8), as lowercase hex."""
    width = max(1, bits // 4)
    return F.expr(f"array_join(transform({lanes}, x -> lpad(lower(hex(x)), {width}, '0')), '')")


def likeness(a: str, b: str, bits: int = BITS):
    """Bias-corrected estimate of the Jaccard similarity of two lane arrays, from 0 to 1."""
    chance = 2.0**-bits
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), z -> z)) / size({a})"
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1.0D when size({a}) = 0 or size({b}) = 0 then 0.0D else greatest(0.0D, ({same} - {chance}D) / {1 - chance}D) end")


def _buckets(docs: DataFrame) -> DataFrame:
    """``doc_id, text, h, bucket``: ``h`` is the text's hash, ``bucket`` a range in the order of id and ``h``.

    Bounds are quantiles of the ids, so any spread of them gives ranges of about ``BUCKET_ROWS`` rows.
    An id that several bounds share is split between them by ``h``; so are null ids.  Equal rows of such ids
    are one row with their number in a further column, ``copies``, which is there if such ids are.
    """
    docs = docs.withColumn("h", F.xxhash64("text"))
    n, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    share = lambda rows: max(1, min(MAX_BUCKETS, -(-rows // BUCKET_ROWS)))
    fractions = ",".join(str(i / share(known)) for i in range(1, share(known)))
    bounds = []
    if fractions:
        bounds = docs.agg(F.expr(f"percentile_approx(doc_id, cast(split('{fractions}', ',') as array<double>), {10 * share(known)})")).first()[0]
    steps = ", ".join(str(1 << i) for i in range(len(bounds).bit_length(), -1, -1))
    values = f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)"
    below = lambda sign: f"aggregate(array({steps}), 0, (at, s) -> case when at + s <= {len(bounds)} and get({values}, at + s - 1) {sign} doc_id then at + s else at end)"
    if not bounds:
        below = lambda sign: "0"
    docs = docs.withColumn("lo", F.expr(below("<"))).withColumn("hi", F.expr(f"case when lo < {len(bounds)} then {below('<=')} else lo end"))
    part = "(h / 18446744073709551616.0D + 0.5D)"  # rises with h from 0 to 1
    inside = f"least(hi, lo + cast(floor({part} * (hi - lo + 1)) as int))"
    null = f"least(-1, cast(floor({part} * {share(n - known)}) as int) - {share(n - known)})"
    rows = docs.select("doc_id", "text", "h", F.expr(f"cast(case when doc_id is null then {null} else {inside} end as long)").alias("bucket"), "lo", "hi")
    wide = F.col("doc_id").isNull() | (F.col("lo") < F.col("hi"))
    if n - known <= BUCKET_ROWS and len(set(bounds)) == len(bounds):
        return rows.drop("lo", "hi")
    equal = rows.where(wide).groupBy("doc_id", "text", "h", "bucket").agg(F.count("*").alias("copies"))
    return rows.where(~wide).drop("lo", "hi").withColumn("copies", F.lit(1).cast("long")).unionByName(equal)


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts (see the module's text for the edges).

    The edited text replaces the last ``floor(n / 2)`` characters by as many from the next
    document's start.  Neighbours are found in one shuffle of the texts by id range; only the
    first document of each range is looked up from another.
    """
    docs = _buckets(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("text")]
    inside = Window.partitionBy("bucket").orderBy(*order)
    d = docs.withColumns({"next_text": F.lead("text").over(inside), "row": F.row_number().over(inside)})
    first = with_lanes(d.where("row = 1").select("bucket", "text"), "text", "lanes")
    # the next range of each: numbers of buckets, ``2 * MAX_BUCKETS`` at most, pass through the one ordered window
    line = Window.orderBy("bucket")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chain = docs.select("bucket").distinct().select("bucket", F.coalesce(F.lead("bucket").over(line), F.first("bucket").over(whole)).alias("following"))
    after = first.select(F.col("bucket").alias("following"), F.col("text").alias("text_after"), F.col("lanes").alias("lanes_after"))
    d = d.join(chain.join(after, "following").drop("following"), "bucket")
    d = d.withColumns({"last": F.col("next_text").isNull(), "next_text": F.coalesce("next_text", "text_after"), "n_chars": F.length("text").cast("long")})
    counted = ["again", "times"] if "copies" in docs.columns else []
    if counted:  # of equal rows all but the last are followed by their own text
        times = F.expr("case when copies = 1 then array(1L) else array(1L, copies - 1) end")
        d = d.select("*", F.posexplode(times).alias("again", "times"))
        own = F.col("again") == 1
        d = d.withColumns({"next_text": F.when(own, F.col("text")).otherwise(F.col("next_text")), "last": F.col("last") & ~own})
    half = "cast(floor(n_chars / 2) as int)"
    d = d.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(next_text, 1, {half}))")).drop("next_text", "text_after")
    d = with_lanes(with_lanes(d, "text", "own"), "edited", "new")
    d = d.select("doc_id", "bucket", "row", *counted, "last", "lanes_after", "n_chars", "own", "new", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"))
    d = d.withColumn("next_own", F.when(F.col("last"), F.col("lanes_after")).otherwise(F.lead("own").over(Window.partitionBy("bucket").orderBy("row", *map(F.desc, counted[:1])))))
    out = [packed("own").alias("fingerprint"), packed("new").alias("edited_fingerprint"), likeness("own", "new").alias("near_edited"), likeness("own", "next_own").alias("near_next")]
    d = d.select("doc_id", "n_chars", "edited_sha256", *out, *counted[1:])
    if counted:
        runs = F.expr(f"transform(sequence(0L, (times - 1) div {COPIES}), i -> least({COPIES}L, times - i * {COPIES}))")
        d = d.withColumn("run", F.explode(runs)).withColumn("copy", F.explode(F.expr("sequence(1L, run)"))).drop("times", "run", "copy")
    return d
