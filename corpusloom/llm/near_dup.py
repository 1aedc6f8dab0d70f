"""Near-duplicate documents by SuperMinHash banding, exact verification and union-find.

1. Documents with equal shingle sets form a class, by a 128-bit digest over two independent hashes
   of every shingle.  All later steps see classes only, so exact copies, however many, cost nothing.
2. Each class gets a SuperMinHash signature of ``BANDS * ROWS`` slots.  A pair of similarity 0.75
   shares no band with probability ``(1 - 0.75**4)**32``, about 5 in a million.
3. A band bucket of at most ``SMALL`` classes offers all its pairs; a larger one offers each
   member with the bucket's least class.  Pairs whose set sizes exclude the similarity, or whose
   signatures agree in fewer than ``ESTIMATE`` of the slots (over five standard deviations
   below 0.75), are dropped; the others are confirmed on full sets, compared by their words.
4. Confirmed links are contracted to components.
5. Buckets over ``SMALL`` whose classes are still in different components are finished by an exact
   prefix join.  Shingles are ordered from rare to common; two linked sets share one among the
   first quarter of each, and the first one that they share leaves enough of both behind it.  A
   header common to many pages stands last in that order, so pages that share only it never meet.
   Shingles that lie in one component alone cannot join two and are skipped.
6. Shingles of step 5 that still hold over ``SMALL`` classes of several components are compared block by
   block: every class outside the main component of such a crowd with all others, inside tasks
   that hold two blocks at a time, first by signature, then with the texts of the classes that this
   leaves.  Only links that join different components leave a task.

Nothing is sampled or capped.  Groups are never gathered whole: a bucket's list has at most
``SMALL`` classes, and a block about ``BLOCK``.

Defined results: a text of fewer than five words has one shingle, its whole sequence; a null text
or one without words has none and is linked with nothing; repeated rows are one document, and rows
of one id with different texts are linked with each other; rows of a null id have a null component;
an empty table gives an empty result; other columns are ignored; a text of any length is hashed in
spans, and its shingles must fit a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Scratch, pieces, shingle_ids, shingle_runs, shingle_sets, string_buffers, words
from .superminhash import band_keys, superminhash

SHINGLE = 5
PERCENT = 75
BANDS = 32
ROWS = 4
SMALL = 32
ESTIMATE = 0.55
BLOCK = 64
SALTS = 16
PIECE_BYTES = 700_000
MAX_CROWDS = 100_000  # main components of at most so many crowds are broadcast, 2 MB


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def sketches(documents: DataFrame, k: int = SHINGLE, with_text: bool = False) -> DataFrame:
    """``doc_id, n_shingles, set_key, sig, bands``, in one pass over the texts; ``with_text``: also ``text``.

    Equal sets have equal 128-bit keys; ``sig`` holds 16 bits of each signature slot.  Key,
    signature and bands of an empty set are null.
    """

    def task(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                data, offsets = string_buffers(part.column(1))
                hashes, start, _ = words(data, offsets, 2)
                bounds = np.searchsorted(start, offsets)
                (runs, at), (other, _) = (shingle_runs(h, bounds, k) for h in hashes)
                found = [np.unique(runs[a:b], return_index=True) for a, b in zip(at[:-1], at[1:])]
                keys = [hashlib.blake2b(x.tobytes() + other[a:][i].tobytes(), digest_size=16).digest() if len(x) else None for (x, i), a in zip(found, at)]
                sets = [x for x, _ in found]
                n = np.array([len(x) for x in sets], np.int64)
                sig = superminhash(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]), BANDS * ROWS)
                low = ((sig ^ (sig >> np.uint64(16)) ^ (sig >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)
                bands = band_keys(sig, ROWS).view(np.int64).tolist()
                sigs = [r.tobytes() if c else None for r, c in zip(low, n)]
                text = [part.column(1)] if with_text else []
                yield _batch(["doc_id", "n_shingles", "set_key", "sig", "bands", "text"][: 5 + len(text)], part.column(0), pa.array(n), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array([b if c else None for b, c in zip(bands, n)], pa.list_(pa.int64())), *text)

    schema = "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>"
    return documents.select("doc_id", "text").mapInArrow(task, schema + (", text string" if with_text else ""))


def _fits(na: str, nb: str) -> str:
    return f"100 * least({na}, {nb}) >= {PERCENT} * greatest({na}, {nb})"


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """``a, b`` of the pairs that sizes and signatures leave possible."""
    a = sigs.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = sigs.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    p = pairs.join(a, "a").join(b, "b").where(_fits("na", "nb"))

    def task(batches):
        for x in batches:
            if x.num_rows:
                sa, sb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(x.num_rows, -1) for c in (2, 3))
                yield x.filter(pa.array((sa == sb).mean(axis=1) >= ESTIMATE)).select(["a", "b"])

    return p.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets of distinct numbers have the similarity."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= PERCENT * (len(both) - same)


def confirm(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The pairs ``a, b`` that are linked, by the words of their full shingle sets.  ``texts``: ``cid, text``."""
    a = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))

    def task(batches):
        for batch in batches:
            for part in pieces(batch, "ta", PIECE_BYTES):
                sets, n = shingle_ids(pa.concat_arrays([part.column(2), part.column(3)]), k), part.num_rows
                yield part.filter(pa.array([_linked(x, y) for x, y in zip(sets[:n], sets[n:])], pa.bool_())).select(["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(task, "a long, b long")


def _with_component(df: DataFrame, comps: DataFrame, key: str, name: str) -> DataFrame:
    c = comps.select(F.col("id").alias(key), F.col("component").alias(name))
    return df.join(c, key, "left").withColumn(name, F.coalesce(name, key))


def _open(df: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` whose rows lie in several components, with the number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(key, "size")


def _join_salted(rows: DataFrame, keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` joined with ``keys`` on ``key``, the rows of each key dealt over ``SALTS`` tasks by their class."""
    salt = F.pmod(F.xxhash64("cid"), F.lit(SALTS))
    keys = keys.select(*keys.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return rows.withColumn("salt", salt).join(keys, [key, "salt"]).select(*columns)


def prefixes(work: Scratch, crowd: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``s, cid, comp, n, rest, size``: the shingles by which classes of ``crowd(cid, comp)`` may be linked.

    ``rest`` counts the shingles of the class from this one on, in the order from rare to common;
    ``size`` the classes that are left at the shingle.  Two linked sets of sizes ``x`` and ``y`` share
    at least ``c = 75 / 175 * (x + y)`` shingles, so the first one that they share has ``rest >= c`` in both.
    """

    def task(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                sets = shingle_sets(part.column(2), k)
                n = np.array([len(x) for x in sets], np.int64)
                own = pa.array(np.repeat(np.arange(len(n)), n))
                yield _batch(["cid", "comp", "n", "s"], part.column(0).take(own), part.column(1).take(own), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64)))

    rows = work.save(crowd.join(texts, "cid").select("cid", "comp", "text").mapInArrow(task, "cid long, comp long, n long, s long"), "crowd_shingles")
    known = _join_salted(rows, _open(rows, "s"), "s", [*rows.columns, "size"])
    mine = Window.partitionBy("cid")
    ranked = known.withColumn("rank", F.row_number().over(mine.orderBy("size", "s"))).withColumn("shared", F.count("*").over(mine))
    found = ranked.select("s", "cid", "comp", "n", (F.col("shared") - F.col("rank") + 1).alias("rest")).where(f"100 * rest >= {PERCENT} * n")
    found = work.save(found, "crowd_prefixes")
    least = found.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("n0"), F.max("rest").alias("r1")).where("lo <> hi").select("s", "n0", "r1")
    partner = f"greatest(n0, ceil({PERCENT} * n / 100))"
    found = _join_salted(found, least, "s", [*found.columns, "n0", "r1"]).where(f"{100 + PERCENT} * least(rest, r1) >= {PERCENT} * (n + {partner})").select("s", "cid", "comp", "n", "rest")
    found = work.save(found, "crowd_left")
    return found.join(_open(found, "s"), "s")


def _prefix_pairs(left: DataFrame) -> DataFrame:
    """``a, b`` of different components at shingles of at most ``SMALL`` classes."""
    groups = left.where(F.col("size") <= SMALL).groupBy("s").agg(F.collect_list(F.struct("cid", "comp", "n", "rest")).alias("m"))
    pairs = groups.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, 1, i), y -> struct(x, y))))")).alias("p"))
    enough = f"{100 + PERCENT} * least(p.x.rest, p.y.rest) >= {PERCENT} * (p.x.n + p.y.n)"
    pairs = pairs.where(f"p.x.comp <> p.y.comp and {enough} and {_fits('p.x.n', 'p.y.n')}")
    return pairs.select(F.expr("greatest(p.x.cid, p.y.cid)").alias("a"), F.expr("least(p.x.cid, p.y.cid)").alias("b")).distinct()


def _block_links(work: Scratch, left: DataFrame, sigs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Links between components inside shingles of over ``SMALL`` classes, by comparing blocks of classes.

    A first pass compares signatures and names the classes of two blocks that may be linked; only
    their texts are sent.  A task of the second pass holds two blocks of a crowd with these texts: for
    each class it looks at the other block's likely partners, the likeliest first, and gives one
    confirmed link to each component.
    """
    ties = left.where(F.col("size") > SMALL)
    pivots = ties.groupBy("s").agg(F.min("cid").alias("pivot"))
    ties = work.save(ties.join(pivots, "s").select("cid", "comp", "pivot").distinct(), "crowd_ties")
    crowds = connected_components(ties.select(F.col("cid").alias("src"), F.col("pivot").alias("dst"))).select(F.col("id").alias("cid"), F.col("component").alias("crowd"))
    people = work.save(crowds.join(ties.select("cid", "comp").distinct(), "cid").join(sigs.select("cid", "n", "sig"), "cid"), "crowd_people")
    per = people.groupBy("crowd", "comp").count()
    main = per.groupBy("crowd").agg(F.max(F.struct("count", (-F.col("comp")).alias("c"))).alias("m"), F.sum("count").alias("size")).select("crowd", (-F.col("m.c")).alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    people = people.join(F.broadcast(main) if main.count() <= MAX_CROWDS else main, "crowd").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    outside = people.where("comp <> main").select("crowd", F.col("block").alias("bu")).distinct()
    blocks, row = ["crowd", "bu", "bv"], ["cid", "comp", "n", "sig"]
    left = people.where("comp <> main").select("crowd", F.col("block").alias("bu"), F.explode(every).alias("bv"), *row)
    right = people.join(outside, "crowd").select("crowd", "bu", F.col("block").alias("bv"), *row)
    right = right.toDF(*right.columns)  # both sides come from one table

    def likely(u: pa.Table, v: pa.Table):
        """For each row of ``u`` its partners among the rows of ``v``, the likeliest first."""
        su, sv = (np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, -1) for t in (u, v))
        cu, nu = (u.column(c).to_numpy() for c in ("comp", "n"))
        cv, nv = (v.column(c).to_numpy() for c in ("comp", "n"))
        for r in range(len(cu)):
            ok = np.flatnonzero((cv != cu[r]) & (100 * np.minimum(nv, nu[r]) >= PERCENT * np.maximum(nv, nu[r])))
            near = (sv[ok] == su[r]).mean(axis=1)
            yield r, ok[np.argsort(-near, kind="stable")][: int((near >= ESTIMATE).sum())]

    def choose(key, u: pa.Table, v: pa.Table) -> pa.Table:
        ours, theirs = np.zeros(u.num_rows, bool), np.zeros(v.num_rows, bool)
        if u.num_rows and v.num_rows:
            for r, found in likely(u, v):
                ours[r] = len(found) > 0
                theirs[found] = True
        sides = [t.select(row).filter(pa.array(keep)) for t, keep in ((u, ours), (v, theirs))]
        out = pa.concat_tables([t.append_column("outside", pa.array(np.full(t.num_rows, x))) for t, x in zip(sides, (True, False))])
        for c, value in zip(reversed(blocks), reversed(key)):
            out = out.add_column(0, c, pa.repeat(value, out.num_rows))
        return out

    def compare(key, u: pa.Table, v: pa.Table) -> pa.Table:
        out = []
        if u.num_rows and v.num_rows:
            iu, iv, cv = u.column("cid").to_numpy(), v.column("cid").to_numpy(), v.column("comp").to_numpy()
            sets = shingle_ids(pa.concat_arrays([*u.column("text").chunks, *v.column("text").chunks]), k)
            sets_u, sets_v = sets[: len(iu)], sets[len(iu) :]
            for r, found in likely(u, v):
                joined = set()
                for j in found:
                    if cv[j] not in joined and _linked(sets_u[r], sets_v[j]):
                        joined.add(cv[j])
                        out.append((iu[r], iv[j]))
        a, b = (np.array([o[i] for o in out], np.int64) for i in (0, 1))
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    schema = "crowd long, bu int, bv int, cid long, comp long, n long, sig binary, outside boolean"
    chosen = left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInArrow(choose, schema)
    chosen = work.save(chosen, "crowd_chosen").join(texts, "cid")
    left, right = (chosen.where(F.col("outside") == x).drop("outside") for x in (True, False))
    right = right.toDF(*right.columns)
    return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInArrow(compare, "a long, b long").distinct()


def _class_texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``cid, text`` for ``wanted(cid, rep, set_key)``: one text of each class.

    Where rows repeat an id, the class's text is found among them by its key.
    """
    found = docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id")
    often = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if often.isEmpty():
        return found.select("cid", "text")
    several = docs.join(often, "doc_id", "left_semi").distinct()
    keys = sketches(several, k, with_text=True).select("doc_id", F.col("set_key").alias("own"), F.col("text").alias("own_text"))
    several = found.join(often, "doc_id", "left_semi").select("doc_id", "cid", "set_key").distinct().join(keys, "doc_id").where("own = set_key")
    return found.join(often, "doc_id", "left_anti").select("cid", "text").unionByName(several.groupBy("cid").agg(F.min("own_text").alias("text")))


def near_duplicates(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``."""
    spark = documents.sparkSession
    work = Scratch(spark, "near_dup")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = work.save(sketches(docs, k), "sketches")
    sets = known.where("set_key is not null and doc_id is not null").groupBy("set_key")
    classes = sets.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    sigs = work.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    classes = sigs.select("cid", "rep", "set_key")

    slots = sigs.select("cid", F.posexplode("bands").alias("band", "key"))
    bucket = F.struct("band", "key").alias("bucket")
    sizes = slots.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("cid").alias("pivot")).where("size > 1")
    members = work.save(slots.join(sizes, ["band", "key"]).select(bucket, "cid", "size", "pivot"), "members")
    small = members.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("cid")).alias("m"))
    small = small.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, 1, i), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    large = members.where(F.col("size") > SMALL)
    stars = large.where("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b"))
    pairs = work.save(_likely(small.unionByName(stars).distinct(), sigs), "pairs")

    involved = pairs.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(large.select("cid")).distinct()
    texts = work.save(_class_texts(docs, classes.join(involved, "cid", "left_semi"), k), "texts")
    # first one pair for each class, then only those that still lie between components
    first = pairs.groupBy("a").agg(F.min("b").alias("b"))
    links = work.save(confirm(first, texts, k), "links1")
    comps = connected_components(links, "a", "b")
    rest = _with_component(_with_component(pairs, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").select("a", "b")
    rest = rest.join(first.withColumnRenamed("b", "tried"), "a").where("b <> tried").select("a", "b")
    links = links.unionByName(work.save(confirm(rest, texts, k), "links2"))
    comps = connected_components(links, "a", "b")

    spread = _with_component(large.select("bucket", "cid"), comps, "cid", "comp")
    crowd = work.save(_join_salted(spread, _open(spread, "bucket"), "bucket", ["cid", "comp"]).distinct(), "crowd")
    if not crowd.isEmpty():
        left = work.save(prefixes(work, crowd, texts, k), "crowd_open")
        links = links.unionByName(work.save(confirm(_likely(_prefix_pairs(left), sigs), texts, k), "links3"))
        comps = connected_components(links, "a", "b")
        left = _with_component(left.drop("comp", "size"), comps, "cid", "comp")
        left = work.save(left.join(_open(left, "s"), "s"), "crowd_large")
        if not left.where(F.col("size") > SMALL).isEmpty():
            links = links.unionByName(work.save(_block_links(work, left, sigs, texts, k), "links4"))
    # texts of one id belong together
    ids = known.where("set_key is not null and doc_id is not null").select("doc_id", "set_key")
    several = ids.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("set_key").alias("first")).where("rows > 1")
    same = ids.join(several, "doc_id").where("set_key <> first").select("set_key", "first").distinct()
    same = same.join(classes.select("set_key", F.col("cid").alias("a")), "set_key").join(classes.select(F.col("set_key").alias("first"), F.col("cid").alias("b")), "first")
    links = links.unionByName(same.select("a", "b"))

    named = _with_component(classes, connected_components(links, "a", "b"), "cid", "comp")
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = work.save(named.join(least, "comp").select("set_key", "component_id"), "components")
    work.drop("classes", "members", "pairs", "texts", "links1", "links2", "links3", "links4", "crowd", "crowd_shingles", "crowd_prefixes", "crowd_left", "crowd_open", "crowd_large", "crowd_ties", "crowd_people", "crowd_chosen")
    out = known.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
