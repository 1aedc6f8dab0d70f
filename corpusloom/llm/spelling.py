"""Spelling variant grouping by an even-partition pigeonhole join.

Of two words that are one edit apart, the shorter (or equal) one is cut evenly into two segments, the
place of the cut depending on its length; the edit touches one of them, so the other stands unchanged in
the longer word: the first segment at its own place, the second shifted by the difference in length.
Every word is therefore indexed under its two segments and probes, as an equal or one-longer word, the
segments of its own length and of one less.  Words that meet are candidates; they are made distinct
and verified to be one edit apart.

A common segment would pair all words that hold it.  Where both sides of a key have more than ``CROWD``
words, the rest of the word is cut again by the same rule and the key grows by one of its halves, until
the key is small or all but one letter is in it (then every pair is a true one).  No pair is lost and no
key is paired in full; the loop ends after as many levels as a word can be halved.

Defined results: null texts have no words; a null id counts as empty text in the hash that picks the
letters to delete; repeated rows count again; ties between forms go to the smaller word by code
points; an empty table has no words; other columns are ignored.  A long text or run is handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LETTERS = "a-zÀ-ÿ"  # after A-Z are lower-cased
LEAST_LENGTH = 7
LEAST_COUNT = 2
DROP_EVERY = 31
TIMES = 10
CROWD = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """``word, n``: distinct words of enough letters and occurrences, after the letters chosen by hash are deleted."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    w = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_w"))
    w = w.select("_w", F.crc32(F.concat("_id", F.lit(":"), "_w")).alias("_h"), F.length("_w").alias("_n"))
    at = (F.col("_h") % F.col("_n")).cast("int")
    less = F.concat(F.col("_w").substr(F.lit(1), at), F.col("_w").substr(at + 2, F.col("_n")))
    word = F.when(F.col("_h") % drop_every == 0, less).otherwise(F.col("_w"))
    return w.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halve(rows: DataFrame) -> DataFrame:
    """Each row twice: its key grown by one half of ``rest``, and the other half as the new rest.

    ``a`` is the length of the indexed word's rest; a probing word's rest may be one longer.
    """
    h = F.floor(F.col("a") / 2).cast("int")
    n = F.length("rest")
    tail = F.col("a") - h
    first = F.struct(F.concat("key", F.lit("|<"), F.col("rest").substr(F.lit(1), h)).alias("key"), F.col("rest").substr(h + 1, n).alias("rest"), tail.alias("a"))
    second = F.struct(F.concat("key", F.lit("|>"), F.col("rest").substr(n - tail + 1, n)).alias("key"), F.col("rest").substr(F.lit(1), n - tail).alias("rest"), h.alias("a"))
    return rows.select("word", "n", "probe", F.explode(F.array(first, second)).alias("x")).select("word", "n", "probe", "x.key", "x.rest", "x.a")


def near_pairs(words: DataFrame, work: Scratch, crowd: int = CROWD) -> DataFrame:
    """``a, na, b, nb``: every unordered pair of words of ``words(word, n)`` that are one edit apart, once."""
    size = F.length("word")
    as_index = words.select("word", "n", F.lit(False).alias("probe"), size.alias("a"))
    as_probe = words.select("word", "n", F.lit(True).alias("probe"), F.explode(F.array(size, size - 1)).alias("a"))
    rows = _halve(as_index.unionByName(as_probe).select("word", "n", "probe", F.col("a").cast("string").alias("key"), F.col("word").alias("rest"), "a"))
    found, level = None, 0
    while True:
        rows = work.save(rows, f"keys{level}")
        sides = rows.groupBy("key").agg(F.sum(F.col("probe").cast("int")).alias("p"), F.sum((~F.col("probe")).cast("int")).alias("i"), F.max("a").alias("left"))
        sides = work.save(sides.where("p > 0 and i > 0").select("key", ((F.least("p", "i") > crowd) & (F.col("left") > 1)).alias("crowded")), f"sides{level}")
        ready = rows.join(sides.where("not crowded").select("key"), "key", "left_semi")
        i = ready.where("not probe").select("key", F.col("word").alias("s"), F.col("n").alias("ns"))
        p = ready.where("probe").select("key", F.col("word").alias("r"), F.col("n").alias("nr"))
        # of two words of one length the smaller one counts as indexed
        met = i.join(p, "key").where("length(r) > length(s) or r > s").select("s", "ns", "r", "nr")
        found = met if found is None else found.unionByName(met)
        if sides.where("crowded").isEmpty():
            break
        rows = _halve(rows.join(sides.where("crowded").select("key"), "key", "left_semi"))
        level += 1
    found = found.distinct().where(F.levenshtein("s", "r", 1) == 1)
    return work.save(found.select(F.col("s").alias("a"), F.col("ns").alias("na"), F.col("r").alias("b"), F.col("nr").alias("nb")), "pairs")


def group_variants(words: DataFrame, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for ``words(word, n)``.

    A word's form is its near word of largest count (ties: the smaller word), if that is ``times`` its own;
    its root is where the chain of forms ends.  Counts grow along a chain, so it is short and has no loops.
    """
    work = Scratch(words.sparkSession, "spelling")
    words = work.save(words.select("word", "n"), "words")
    pairs = near_pairs(words, work, crowd)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("o"), F.col("nb").alias("on")).unionAll(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("on")).alias("m"), "o")).alias("x"))
    is_form = -F.col("x.m") >= times * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("x.o")).alias("form"), F.when(is_form, -F.col("x.m")).alias("form_n"))
    rows = work.save(rows, "forms")
    chain = work.save(rows.where("form is not null").select("word", F.col("form").alias("root")), "chain0")
    for k in range(1, 64):  # pointer doubling
        up = chain.select(F.col("word").alias("root"), F.col("root").alias("up"))
        nxt = work.save(chain.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), f"chain{k}")
        chain = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            break
    return rows.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """The variants of all words of the documents' texts."""
    return group_variants(vocabulary(documents))
