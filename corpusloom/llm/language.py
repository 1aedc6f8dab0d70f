"""Language identification by cross-parsing entropy (Ziv-Merhav).

Each language is a suffix automaton of a reference text, built from labelled documents.  A text is
parsed against it from left to right into the longest matches; a text in the language is made of
few long phrases, any other of many short ones.  The language with the fewest phrases a character
wins (on a tie, the first in alphabetical order).

Texts are lower-cased and reduced to letters with single separators between them.  Automata are
stored as dense transition tables and walked in lockstep: every text is cut into lanes of ``LANE``
characters and one numpy step advances all lanes of all languages by a character.  All of a text is
read, whatever its length; a lane's start counts as a phrase's start for every language alike.

Transitions of the ``SYMBOLS - 2`` commonest letters are columns of the table; those of all other
letters of the references are found in one sorted list, so every letter is told apart.

Fitting takes a bounded sample: the ``MAX_LANGS`` commonest languages, about ``SAMPLE_DOCS`` documents of
each, chosen by hash, and of these as many whole texts as have ``REFERENCE_CHARS`` reduced characters
together (an equal share of ``TOTAL_CHARS``, if that is less).  Only a language whose sample has no text
that short learns from the beginning of its shortest one.  The tables take about 320 bytes a
character, at most 128 MB.

The score is the share of the second-best language in the phrases of the two best: 0.5 if they need
equally many, nearer to 1 the fewer the best needs; it does not depend on the text's length.

Defined results: ``und`` with score 0 for a null text or one without a letter; rows of a null
language are not learned from; with one learned language scores are 1; without any labelled row every text
is ``und``; repeated rows give repeated results and are learned from once; an empty table gives an empty
result; other columns are ignored or, if asked for, kept under any name.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_and_add, pieces

SAMPLE_DOCS = 300
REFERENCE_CHARS = 40_000
TOTAL_CHARS = 400_000
MAX_LANGS = 1000
SYMBOLS = 40
LANE = 512
FOLDS = 5


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def reduce_text(text: str) -> np.ndarray:
    """Lower-case letters of a text, with 0 for each run of anything else between them."""
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = x > 0
    keep[1:] |= x[:-1] > 0
    x = x[keep]
    return x[:-1] if len(x) and not x[-1] else x


def suffix_automaton(symbols: list[int], n_symbols: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Transitions ``[state, symbol]`` of the suffix automaton; state 0 is the start, 0 no move.

    Those of symbols from ``n_symbols`` on are returned as a list of ``state, symbol, next``.
    """
    moves, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.zeros((len(moves), n_symbols), np.int32)
    rare = []
    for s, m in enumerate(moves):
        for c, t in m.items():
            if c < n_symbols:
                table[s, c] = t
            else:
                rare.append((s, c, t))
    return table, rare


class Model:
    """The automata of all languages, one below the other in one table."""

    def __init__(self, references: dict[str, list[str]], chars: int = REFERENCE_CHARS, symbols: int = SYMBOLS):
        self.langs = sorted(references)
        reduced = {k: [reduce_text(t) for t in v] for k, v in references.items()}
        counts: Counter[int] = Counter()
        for k in self.langs:
            for x in reduced[k]:
                counts.update(dict(zip(*(a.tolist() for a in np.unique(x[x > 0], return_counts=True)))))
        common = [c for c, _ in sorted(counts.items(), key=lambda i: (-i[1], i[0]))]
        #: all letters of the references; symbol 0 separates words, 1 is any other letter
        self.alphabet = np.array(sorted(common), np.uint32)
        self.places = np.zeros(len(common), np.int32)
        self.places[np.searchsorted(self.alphabet, np.array(common, np.uint32))] = np.arange(len(common)) + 2
        tables, rare, self.roots, at = [], [], [], 0
        for k in self.langs:
            left, text = chars, [0]
            for x in reduced[k]:
                if left > 0 and len(x):
                    part = self.symbols(x[:left])
                    text += [*part.tolist(), 0]
                    left -= len(part)
            t, more = suffix_automaton(text, symbols)
            rare += [(s + at, c, to + at) for s, c, to in more]
            tables.append(np.where(t > 0, t + at, 0))
            self.roots.append(at)
            at += len(t)
        self.table = np.concatenate(tables).astype(np.int32) if tables else np.zeros((1, symbols), np.int32)
        self.n_symbols = symbols
        self.n_letters = len(common) + 2
        keys = np.array([s * self.n_letters + c for s, c, _ in rare], np.int64)
        order = np.argsort(keys)
        #: transitions of the letters that have no column: sorted keys of state and symbol, next states
        self.rare_keys, self.rare_to = keys[order], np.array([to for _, _, to in rare], np.int32)[order]

    def symbols(self, x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, x), max(0, len(self.alphabet) - 1))
        known = self.alphabet[at] == x if len(self.alphabet) else np.zeros(len(x), bool)
        places = self.places[at] if len(self.alphabet) else 1
        return np.where(x == 0, 0, np.where(known, places, 1)).astype(np.int32)

    def _moves(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states, 0 where there is no move; ``c`` is broadcast over ``state``."""
        k = self.n_symbols
        if not len(self.rare_keys):
            return self.table.ravel()[state * k + c]
        c = np.broadcast_to(c, state.shape)
        out = self.table.ravel()[state * k + np.where(c < k, c, 1)]  # no reference holds symbol 1
        far = np.nonzero(c >= k)
        if len(far[0]):
            keys = state[far].astype(np.int64) * self.n_letters + c[far]
            at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
            out[far] = np.where(self.rare_keys[at] == keys, self.rare_to[at], 0)
        return out

    @functools.cached_property
    def _codes(self) -> np.ndarray:
        """Symbols of code points, -1 for what is no letter."""
        low = _letters()
        return np.where(low > 0, self.symbols(low), -1).astype(np.int32)

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ``[text, language]`` and the number of reduced characters of each text."""
        raw = "\0".join(t or "" for t in texts) + "\0"
        x = self._codes[np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4")]
        ends = np.cumsum([len(t or "") + 1 for t in texts])
        keep = x != -1
        keep[1:] |= keep[:-1] & (x[1:] == -1)
        bounds = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
        x = x[keep]
        x[x == -1] = 0
        size = np.diff(bounds)
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        start = bounds[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        width = np.minimum(LANE, bounds[owner + 1] - start)
        order = np.argsort(-width, kind="stable")
        start, width, owner = start[order], width[order], owner[order]
        n_langs, n = len(self.langs), len(start)
        count = np.zeros((n_langs, n), np.int32)
        root = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(root, n, axis=1) if n else np.zeros((n_langs, 0), np.int32)
        fresh = np.ones((n_langs, n), bool)  # where the next character begins a phrase in any case
        lost_any = False
        active = np.searchsorted(-width, -np.arange(1, LANE + 1), side="right")  # lanes longer than t
        for t in range(int(width[0]) if n else 0):
            m = int(active[t])
            c = x[start[:m] + t]
            s = self._moves(state[:, :m], c)
            dead = s == 0
            count[:, :m] += dead | fresh[:, :m] if t == 0 or lost_any else dead
            where = np.nonzero(dead)
            s[where] = self._moves(root[where[0], 0], c[where[1]])  # a new phrase begins with this character
            lost = s[where] == 0
            if t == 0 or lost_any:
                fresh[:] = False
            lost_any = bool(lost.any())
            if lost_any:  # a character that the language has never shown is a phrase by itself
                at = where[0][lost], where[1][lost]
                s[at], fresh[at] = root[at[0], 0], True
            state[:, :m] = s
        out = np.zeros((len(texts), n_langs), np.int64)
        for j in range(n_langs):
            np.add.at(out[:, j], owner, count[j])
        return out, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        z, size = self.phrases(texts)
        best = z.argmin(axis=1)
        two = np.sort(z, axis=1)[:, :2].astype(float)
        score = two[:, 1] / np.maximum(two.sum(axis=1), 1) if z.shape[1] > 1 else np.ones(len(texts))
        return ["und" if not n else self.langs[b] for b, n in zip(best, size)], np.where(size > 0, score, 0.0)


def held_out(folds: int = FOLDS):
    """Whether a row is held out: ``crc32`` of its id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def choose(lengths: list[int], wanted: int) -> list[int]:
    """The places of the texts to learn from: in order, each that still fits into ``wanted`` characters."""
    out, left = [], wanted
    for i, n in enumerate(lengths):
        if 0 < n <= left:
            out.append(i)
            left -= n
    return out or [min((i for i, n in enumerate(lengths) if n), key=lambda i: lengths[i])] if any(lengths) else []


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from labelled documents that are not held out."""
    rows = documents.select("doc_id", "lang", "text").where("lang is not null and text is not null").where(~held_out())
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return Model({})
    wanted = min(REFERENCE_CHARS, TOTAL_CHARS // len(counts))
    rates = documents.sparkSession.createDataFrame([(r["lang"], min(1.0, sample_docs / max(1, r["n"]))) for r in counts], "lang string, rate double")
    sample = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    sample = sample.select("lang", "h", "text").dropDuplicates(["lang", "h"])

    def reduced(batches):
        for batch in batches:
            for part in pieces(batch, "text", 3_000_000):
                texts = ["".join(chr(c) if c else " " for c in reduce_text(t).tolist()) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([t[:wanted] for t in texts], pa.string())], names=["lang", "h", "n", "text"])

    saved = Scratch(documents.sparkSession, "language").save(sample.mapInArrow(reduced, "lang string, h long, n long, text string"), "sample")
    sizes: dict[str, list] = {}
    for r in saved.select("lang", "h", "n").collect():
        sizes.setdefault(r["lang"], []).append((r["h"], r["n"]))
    picked = []
    for k, v in sizes.items():
        v.sort()
        picked += [(k, v[i][0]) for i in choose([n for _, n in v], wanted)]
    if not picked:
        return Model({})
    chosen = documents.sparkSession.createDataFrame(picked, "lang string, h long")
    refs: dict[str, list] = {}
    for r in saved.join(F.broadcast(chosen), ["lang", "h"]).collect():
        refs.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return Model({k: [t for _, t in sorted(v)] for k, v in refs.items()}, wanted)


def predict(documents: DataFrame, model: Model, keep: list[str], lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``keep`` columns of the documents with the columns ``lang`` and ``score``, names that are not among them."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def task(texts: pa.Array):
        found, scores = shared.value.predict(texts.to_pylist())
        return [pa.array(found, pa.string()), pa.array(scores)]

    return keep_and_add(documents, keep, task, {lang: "string", score: "double"})


def identify(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of all documents."""
    model = fit(documents)
    return predict(documents, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
