"""Title and tag similarity: scores, bounds, and the pair joins built on them.

The title part of every score is difflib's ratio, which is not symmetric; its
arguments are oriented by note_id. Pairs are met in tiles: the notes of a key,
dealt into parts of bounded size, every two parts forming one tile. Lengths,
tags and tokens in common, then the characters of the titles bound the score,
and only what they leave open is aligned, many pairs at once, on words of bits.

A pair above the weight of the title alone must share a tag or a token, and
one of either alone is rarely enough. So keys are couples: two tags, a tag and
a token, two tokens; a single value is a key for the notes only that it may
still carry above the threshold. What a pair has in common names the one key
under which it counts, so nothing is lost and no pair comes out twice. Below
that weight all notes have one key. Bodies never take part in a join of notes
with notes.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vaultlens.functions import text as T
from vaultlens.plans.runtime import materialize, numbered

#: Weights of title, tags and title tokens.
DEDUP, AUDIT = (0.5, 0.3, 0.2), (0.7, 0.3, 0.0)
#: Notes of a part; a tile compares two parts.
PER_PART = 1000
#: Pairs that one task compares, about.
PER_TASK = 20_000_000
#: Values that more notes of a tile have are counted by a matrix product, rarer ones pair by pair.
DENSE = 24
#: Tokens too common in titles to relate notes.
STOP_TOKENS = ["через", "между", "после", "вокруг", "вместо", "against", "using", "about"]


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts, in this order."""
    m, seen, out = SequenceMatcher(None), None, []
    for x, y in zip(a, b):
        if y != seen:
            m.set_seq2(y)
            seen = y
        m.set_seq1(x)
        out.append(m.ratio())
    return pd.Series(out)


#: Characters up to which a text's places fit the bits of a word; longer ones are aligned by difflib itself.
BITS = 64
#: Pairs that are aligned at once.
AT_ONCE = 4096
#: How often a character is counted by a bit of its own.
LEVELS = 5


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, the code points of all texts, and the text of each."""
    size = np.array([len(t) for t in texts], np.int64)
    return size, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.repeat(np.arange(len(texts)), size)


def char_bits(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text a word per level, whose bits are the classes of characters it has so often, and the number of characters beyond."""
    _, codes, of = coded(texts)
    counts = np.bincount(of * 64 + codes % 64, minlength=len(texts) * 64).reshape(len(texts), 64)
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return np.stack([np.where(counts > k, bit, np.uint64(0)).sum(axis=1, dtype=np.uint64) for k in range(LEVELS)]), np.maximum(counts - LEVELS, 0).sum(axis=1)


def most_in_common(bits: np.ndarray, beyond: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At least as many as the characters that texts x and y have in common."""
    out = np.minimum(beyond[x], beyond[y])
    for word in bits:
        out += np.bitwise_count(word[x] & word[y])
    return out


def _matching(rows: np.ndarray, places: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """difflib's matching characters of texts x with texts y, of up to BITS characters; -1 where they are fewer than needed.

    rows has the characters of each text, places the places of each character
    in each text, as bits. As in difflib the longest block, of several the
    first in x and then in y, splits a pair into what is before and behind.
    """
    one = np.uint64(1)
    below = np.append((one << np.arange(64, dtype=np.uint64)) - one, ~np.uint64(0))
    width = int(size[x].max())
    same = places[y[:, None], rows[x, :width]]
    got = np.zeros(len(x), np.int64)
    p, a, b, c, d = np.arange(len(x)), np.zeros(len(x), np.int64), size[x], np.zeros(len(x), np.int64), size[y]
    while len(p):
        cut: list[tuple[np.ndarray, ...]] = []
        w = b - a
        for low, high in ((0, 4), (4, 9), (9, 18), (18, BITS)):
            s = np.flatnonzero((w > low) & (w <= high))
            if not len(s):
                continue
            at = a[s, None] + np.arange(int(w[s].max()))
            first = same[p[s, None], np.minimum(at, width - 1)] & (below[d[s]] & ~below[c[s]])[:, None]
            first[at >= b[s, None]] = 0
            some = first.any(axis=1)
            s, first = s[some], first[some]
            run, k = first, 1
            while len(s):
                more = run[:, :-1] & (first[:, k:] >> np.uint64(k))
                on = more.any(axis=1)
                end = np.flatnonzero(~on)
                if len(end):
                    i = (run[end] != 0).argmax(axis=1)
                    word = run[end, i]
                    j = np.bitwise_count((word & (~word + one)) - one).astype(np.int64)
                    e, i = s[end], i + a[s[end]]
                    got += k * np.bincount(p[e], minlength=len(got))
                    cut += [(p[e], a[e], i, c[e], j), (p[e], i + k, b[e], j + k, d[e])]
                    s, first, more = s[on], first[on], more[on]
                run, k = more, k + 1
        if not cut:
            break
        p, a, b, c, d = (np.concatenate(z) for z in zip(*cut))
        left = np.minimum(b - a, d - c)
        most = got + np.bincount(p, weights=left, minlength=len(got)).astype(np.int64)
        go = (left > 0) & (most >= need)[p]
        got[most < need] = -1
        p, a, b, c, d = p[go], a[go], b[go], c[go], d[go]
    got[got < need] = -1
    return got


def ratios_from(texts: list[str], x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """difflib's ratio of the texts x with the texts y, missing where characters in common or blocks found so far show that it is below least."""
    out = np.full(len(x), np.nan)
    if len(x):
        texts, code = np.unique(np.array(texts, dtype=object), return_inverse=True)
        x, y, size = code[x], code[y], np.array([len(t) for t in texts], np.int64)
        open_ = np.flatnonzero((x == y) | (most_in_common(*char_bits(texts), x, y) >= (least - 1e-9) * (size[x] + size[y]) / 2))
        out[open_] = _aligned_ratios(texts, x[open_], y[open_], least[open_])
    return out


def _aligned_ratios(texts: list[str], x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The same for texts that are all different, by alignment alone."""
    out = np.full(len(x), np.nan)
    out[x == y] = 1.0
    open_ = np.flatnonzero(x != y)
    if not len(open_):
        return out
    used, at = np.unique(np.concatenate([x[open_], y[open_]]), return_inverse=True)
    x, y = at[: len(open_)], at[len(open_) :]
    texts = [texts[k] for k in used]
    size, codes, of = coded(texts)
    total = size[x] + size[y]
    need = (least[open_] - 1e-9) * total / 2
    fit = (size[x] <= BITS) & (size[y] <= BITS)
    m, seen = SequenceMatcher(None), -1
    long = np.flatnonzero(~fit)
    for k in long[np.argsort(y[long], kind="stable")]:
        if y[k] != seen:
            seen = y[k]
            m.set_seq2(texts[seen])
        m.set_seq1(texts[x[k]])
        out[open_[k]] = m.ratio()
    short = (size <= BITS)[of]
    place = (np.arange(len(of)) - (np.cumsum(size) - size)[of])[short]
    of, (_, char) = of[short], np.unique(codes[short], return_inverse=True)
    rows = np.zeros((len(texts), BITS), np.int64)
    rows[of, place] = char + 1  # 0 stands behind the end and is nowhere
    places = np.zeros((len(texts), int(char.max(initial=-1)) + 2), np.uint64)
    np.bitwise_or.at(places, (of, char + 1), np.uint64(1) << place.astype(np.uint64))
    fit = np.flatnonzero(fit)
    for k in range(0, len(fit), AT_ONCE):
        o = fit[k : k + AT_ONCE]
        got = _matching(rows, places, size, x[o], y[o], need[o])
        out[open_[o]] = np.where(got < 0, np.nan, 2.0 * got / total[o])
    return out


def _in_common(rows: np.ndarray, values: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each left row has in common with each right one; values are different within a row."""
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    place = np.full((2, n), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    often = count > DENSE
    col = np.cumsum(often) - 1
    sides = []
    for side, size in ((0, len(left)), (1, len(right))):
        hot = np.zeros((size, int(often.sum())), np.float32)
        k = often[code] & (place[side, rows] >= 0)
        hot[place[side, rows[k]], col[code[k]]] = 1
        sides.append(hot)
    out = sides[0] @ sides[1].T
    k = ~often[code] & (count[code] > 1)
    order = np.argsort(code[k], kind="stable")
    r, c = rows[k][order], code[k][order]
    flat = [np.empty(0, np.int64)]
    for d in range(-min(DENSE, len(r)) + 1, min(DENSE, len(r))):
        u, v = (r[: len(r) - d], r[d:]) if d >= 0 else (r[-d:], r[:d])
        cu, cv = (c[: len(c) - d], c[d:]) if d >= 0 else (c[-d:], c[:d])
        ok = (cu == cv) & (place[0, u] >= 0) & (place[1, v] >= 0)
        flat.append(place[0, u[ok]] * len(right) + place[1, v[ok]])
    np.add.at(out.reshape(-1), np.concatenate(flat), np.float32(1))
    return out


#: How a pair is met: under all notes; a value of a long note; two tags; a tag and a token; its only value in common, a tag; two tokens; its only value in common, a token.
ALL, LONG, GG, GK, G, KK, K = range(7)
#: Tags or tokens up to which a note is met under two values at once.
COUPLED = 12
#: Rows of a tile up to which all its pairs are written out at once.
SMALL = 24


class _Rows:
    """The notes of some tiles as arrays, and the similar pairs among them."""

    def __init__(self, t: pa.Table, weights: tuple[float, float, float], threshold: float) -> None:
        self.weights, self.threshold = weights, threshold
        for c in ("note_id", "part", "kind", "e1", "e2", "tile"):
            setattr(self, c, t.column(c).to_numpy())
        low = t.column("low").combine_chunks().dictionary_encode()
        self.text, self.titles = low.indices.to_numpy(), low.dictionary.to_pylist()
        self.length = np.array([len(x) for x in self.titles], np.int64)[self.text]
        self.bits, self.beyond = char_bits(self.titles)
        self.flat, self.size, self.wide = [], [], []
        for c in ("tags", "tokens"):
            x = t.column(c).combine_chunks()
            values, n = x.flatten().to_numpy(), np.diff(x.offsets.to_numpy()).astype(np.int64)
            of = np.repeat(np.arange(len(n)), n)
            wide = np.zeros((len(n), int(n.max(initial=0))), np.int64)
            wide[of, np.arange(len(of)) - (np.cumsum(n) - n)[of]] = values
            self.flat.append((of, values, np.cumsum(n) - n))
            self.size.append(n)
            self.wide.append(wide)

    def set_bounds(self, kind: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The most that tags and tokens add to the score of pairs met in a way, as far as sizes tell; i and j broadcast."""
        out: np.ndarray = np.float32(0)
        for size, w, one, none in ((self.size[0], self.weights[1], (G, GK), (KK, K)), (self.size[1], self.weights[2], (K,), (G,))):
            if w and kind not in none:
                a, b = size[i].astype(np.float32), size[j].astype(np.float32)
                out = out + w * (1 / np.maximum(a + b - 1, 1) if kind in one else np.minimum(a, b) / np.maximum(np.maximum(a, b), 1))
        return out

    def in_tile(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a tile that lengths, tags and tokens leave open, and what tags and tokens add to the score at most."""
        wt, wg, wk = self.weights
        two = self.part[s] != self.part[e - 1]
        m = int(np.searchsorted(self.part[s:e], self.part[s], "right"))
        left, right = (np.arange(m), np.arange(m, e - s)) if two else (np.arange(e - s), np.arange(e - s))
        kind = self.kind[s]
        if kind == G and wt:
            return self.by_length(left + s, right + s)
        i, j = left[:, None] + s, right[None, :] + s
        sets = np.zeros((len(left), len(right)), np.float32)
        if kind == G:
            sets += self.set_bounds(kind, i, j)
        else:
            for f, w, known in ((0, wg, {GK: 1, KK: 0, K: 0}), (1, wk, {K: 1})):
                if not w or known.get(kind) == 0:
                    continue
                (of, values, starts), size = self.flat[f], self.size[f]
                x = slice(starts[s], starts[e - 1] + size[e - 1])
                both = np.float32(1) if kind in known else _in_common(of[x] - s, values[x], e - s, left, right)
                sets += np.float32(w) * both / np.maximum(size[i].astype(np.float32) + size[j].astype(np.float32) - both, np.float32(1))
        bound = sets
        if wt:
            a, b = self.length[i].astype(np.float32), self.length[j].astype(np.float32)
            bound = np.where(a + b == 0, np.float32(wt), np.float32(2 * wt) * np.minimum(a, b) / np.maximum(a + b, np.float32(1))) + sets
        may = bound >= self.threshold - 1e-5
        x, y = np.nonzero(may if two else np.triu(may, 1))
        return left[x] + s, right[y] + s, sets[x, y]

    def by_length(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same where one tag is all that is in common: lengths alone tell, and the notes of fitting ones are looked up."""
        wt, wg, _ = self.weights
        size, found = self.size[0], [(np.empty(0, np.int64),) * 2]
        for q in np.unique(size[right]):
            r = right[size[right] == q]
            r = r[np.argsort(self.length[r], kind="stable")]
            least = np.clip((self.threshold - 1e-5 - wg / (size[left] + q - 1)) / wt, 1e-9, None)
            n = self.length[left]
            a = np.searchsorted(self.length[r], np.ceil(n * least / (2 - np.minimum(least, 1)) - 1e-6), "left")
            b = np.searchsorted(self.length[r], np.floor(n * (2 - np.minimum(least, 1)) / least + 1e-6), "right")
            b = np.where(least > 1, a, np.maximum(a, b))
            of = np.repeat(np.arange(len(left)), b - a)
            found.append((left[of], r[np.arange(len(of)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[of]]))
        i, j = (np.concatenate(z) for z in zip(*found))
        if left[0] == right[0]:  # one part: each pair was found from both sides
            k = i < j
            i, j = i[k], j[k]
        return i, j, np.broadcast_to(self.set_bounds(G, i, j), i.shape)

    def in_small_tiles(self, small: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs of the rows whose tiles are small, and what tags and tokens add to the score at most."""
        first = np.flatnonzero(np.r_[True, self.tile[1:] != self.tile[:-1]])
        two = np.repeat(np.maximum.reduceat(self.part, first) != np.minimum.reduceat(self.part, first), np.diff(np.r_[first, len(self.tile)]))
        for d in range(1, min(SMALL, len(self.tile))):
            i = np.flatnonzero(small[:-d] & (self.tile[:-d] == self.tile[d:]) & (~two[:-d] | (self.part[:-d] != self.part[d:])))
            sets = np.zeros(len(i), np.float32)
            for kind in np.unique(self.kind[i]):
                k = np.flatnonzero(self.kind[i] == kind)
                sets[k] = self.set_bounds(kind, i[k], i[k] + d)
            yield i, i + d, sets

    def scored(self, i: np.ndarray, j: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids a, b and scores of the pairs that are similar and met here before all."""
        wt, wg, wk = self.weights
        swap = self.note_id[i] > self.note_id[j]
        x, y = np.where(swap, j, i), np.where(swap, i, j)
        if wt:
            total = self.length[x] + self.length[y]
            most = np.where(total == 0, 1.0, 2.0 * most_in_common(self.bits, self.beyond, self.text[x], self.text[y]) / np.maximum(total, 1))
            k = np.flatnonzero(wt * most + sets >= self.threshold - 1e-5)
            x, y = x[k], y[k]
            most = most[k]
        else:
            most = np.zeros(len(x))
        n, least = [], []
        for wide, size in zip(self.wide, self.size):
            a, b = wide[x], wide[y]
            both = np.zeros(a.shape, bool)
            for c in range(a.shape[1]):
                both |= (a == b[:, c : c + 1]) & (c < size[y])[:, None]
            both &= np.arange(a.shape[1]) < size[x][:, None]
            n.append(both.sum(axis=1))
            for _ in range(2):
                least.append(a[np.arange(len(x)), both.argmax(axis=1)] if a.shape[1] else np.zeros(len(x), np.int64))
                if a.shape[1]:
                    both[np.arange(len(x)), both.argmax(axis=1)] = False
        g, k = n
        g1, g2, k1, k2 = least
        kind = np.select([g > 1, (g == 1) & (k > 0), g == 1, k > 1, k == 1], [GG, GK, G, KK, K], -1)
        e1 = np.where(g > 0, g1, k1)
        e2 = np.select([kind == GG, kind == GK, kind == KK], [g2, k1, k2], 0)
        now = self.kind[x]
        here = (now == kind) & (self.e1[x] == e1) & (self.e2[x] == e2) | (now == ALL)
        if (now == LONG).any():
            far = np.maximum(*self.size) > COUPLED
            here |= (now == LONG) & (far[x] | far[y]) & (kind >= 0) & (self.e1[x] == e1)
        tags = wg * (g / np.maximum(self.size[0][x] + self.size[0][y] - g, 1))
        tokens = wk * (k / np.maximum(self.size[1][x] + self.size[1][y] - k, 1))
        o = np.flatnonzero(here & (wt * most + tags + tokens >= self.threshold - 1e-9))
        x, y, tags, tokens = x[o], y[o], tags[o], tokens[o]
        score = np.zeros(len(x))
        if wt:
            score = wt * _aligned_ratios(self.titles, self.text[x], self.text[y], (self.threshold - (tags + tokens) - 1e-9) / wt)
        score = score + tags + tokens
        hit = score >= self.threshold
        return self.note_id[x[hit]], self.note_id[y[hit]], score[hit]

    def similar(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.r_[True, self.tile[1:] != self.tile[:-1]])
        ends = np.r_[first[1:], len(self.tile)]
        small = np.repeat(ends - first <= SMALL, ends - first)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        large = (self.in_tile(s, e) for s, e in zip(first, ends) if e - s > SMALL)
        for found in (z for way in (self.in_small_tiles(small), large) for z in way):
            held.append(found)
            if sum(len(z[0]) for z in held) > 200_000:
                yield from self._chunks(held)
                held = []
        yield from self._chunks(held)

    def _chunks(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if held:
            i, j, sets = (np.concatenate(z) for z in zip(*held))
            for k in range(0, len(i), 200_000):
                yield self.scored(*(z[k : k + 200_000] for z in (i, j, sets)))


def keyed(notes: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """note_id, low (lowercased title), and tags and tokens as sorted hashes; none where they have no weight."""
    hashed = lambda kind, c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.xxhash64(F.lit(kind), x))))
    none = F.array().cast("array<bigint>")
    of = lambda weight, x: (x if weight else none)
    return notes.select("note_id", F.lower("title").alias("low"), of(weights[1], hashed("#", "tags")).alias("tags"), of(weights[2], hashed("w", T.title_tokens("title"))).alias("tokens"))


def meetings(k: DataFrame, weights: tuple[float, float, float], threshold: float) -> DataFrame:
    """The rows of keyed() by kind, e1, e2: each way in which a note may meet one it is similar to.

    A pair is met in the one way that its values in common name: the two first
    tags; its only tag and its first token; its only tag; without a tag the two
    first tokens, or the only one. Where values in common are so few that the
    title cannot make up for the rest, the note is not entered: a note of many
    tags for a tag alone, one of many tokens for a token alone.
    """
    wt, wg, wk = weights
    way = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("e1"), b.alias("e2"))
    if threshold <= wt:
        return k.select("*", F.inline(F.array(way(ALL, F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))))
    none = F.lit(0).cast("bigint")
    empty = F.array().cast("array<struct<kind:int,e1:bigint,e2:bigint>>")
    up_to = lambda w, rest: w / (threshold - rest) + 1e-6 if threshold > rest else np.inf
    entered = lambda c, most, x: F.when(F.size(c) <= F.lit(float(most)), x).otherwise(empty)
    couples = lambda c, kind: F.flatten(F.transform(c, lambda a, i: F.transform(F.slice(c, i + F.lit(2), F.lit(COUPLED)), lambda b: way(kind, a, b))))
    ways = [couples("tags", GG), entered("tags", up_to(wg, wt + wk), F.flatten(F.transform("tags", lambda a: F.transform("tokens", lambda b: way(GK, a, b)))))]
    ways.append(entered("tags", up_to(wg, wt), F.transform("tags", lambda a: way(G, a, none))))
    if wt + wk >= threshold - 1e-9:
        ways += [couples("tokens", KK), entered("tokens", max(1, up_to(wk, wt) - 2e-6), F.transform("tokens", lambda a: way(K, a, none)))]
    far = F.greatest(F.size("tags"), F.size("tokens")) > COUPLED
    out = k.where(~far).select("*", F.inline(F.concat(*ways)))
    single = k.select("*", F.explode(F.concat("tags", "tokens")).alias("e1"))
    of = k.where(far).select(F.explode(F.concat("tags", "tokens")).alias("e1")).distinct()
    return out.unionByName(single.join(of, "e1", "left_semi").select(*k.columns, F.lit(LONG).alias("kind"), "e1", none.alias("e2")))


def similar_pairs(notes: DataFrame, weights: tuple[float, float, float], threshold: float) -> DataFrame:
    """a, b (note ids, a < b) and score of all pairs that score threshold or more, whatever it is.

    notes has note_id, title and tags; rows without a title or without an array
    of tags are left out. The work follows the pairs of notes that have two
    tags, a tag and a token or two tokens in common, and of those with one tag
    alone the ones whose lengths leave them open.
    """
    k = materialize(keyed(notes.where("title is not null and tags is not null"), weights), "keyed")
    e = meetings(k, weights, threshold)
    way = ["kind", "e1", "e2"]
    met = materialize(e.groupBy(way).agg(F.count("*").alias("n")).where("n > 1"), "keys")
    work = met.agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0
    tasks = max(notes.sparkSession.sparkContext.defaultParallelism, int(work / PER_TASK) + 1)
    parts = F.ceil(F.col("n") / PER_PART).cast("int")
    e = e.join(met, way).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("note_id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    e = e.withColumn("other", other).withColumn("tile", F.xxhash64(*way, F.least("part", "other"), F.greatest("part", "other")))
    e = e.select("tile", *way, "part", "note_id", "low", "tags", "tokens").repartition(tasks, "tile").sortWithinPartitions("tile", "part", "note_id")

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, b, score in _Rows(pa.Table.from_batches(held).combine_chunks(), weights, threshold).similar():
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], names=["a", "b", "score"])

        # whole tiles, some batches of them at once
        held: list[pa.RecordBatch] = []
        for batch in it:
            of = batch.column("tile").to_numpy()
            if held and len(of):
                before = held[-1].column("tile")[held[-1].num_rows - 1].as_py()
                cut = len(of) if of[-1] == before else int(np.flatnonzero(of != before)[0]) if of[0] == before else 0
                if cut:
                    held.append(batch.slice(0, cut))
                if cut == len(of):
                    continue
                yield from out(held)
                held = []
                batch, of = batch.slice(cut), of[cut:]
            if len(of):
                last = int(np.flatnonzero(of == of[-1])[0])
                if last:
                    yield from out([batch.slice(0, last)])
                held = [batch.slice(last)]
        if held:
            yield from out(held)

    return e.mapInArrow(rows, "a bigint, b bigint, score double")


def without_linked(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """Pairs of which neither note links to the other's title."""
    n = notes.select("note_id", "title", "links")
    j = pairs.join(n.select(F.col("note_id").alias("a"), F.col("title").alias("title_a"), F.col("links").alias("links_a")), "a")
    j = j.join(n.select(F.col("note_id").alias("b"), F.col("title").alias("title_b"), F.col("links").alias("links_b")), "b")
    return j.where(~F.array_contains("links_a", F.col("title_b")) & ~F.array_contains("links_b", F.col("title_a"))).select("a", "b", "score", "title_a", "title_b")


def without_reviewed(pairs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Pairs not in reviewed (notes array<bigint>) as an entry of exactly two; larger entries exclude no pair."""
    two = reviewed.where(F.size(F.array_distinct("notes")) == 2).select(F.array_min("notes").alias("a"), F.array_max("notes").alias("b")).distinct()
    return pairs.join(two, ["a", "b"], "left_anti")


@F.pandas_udf(DoubleType())
def rounded(score: pd.Series) -> pd.Series:
    """To three places, of the number as it is stored; Spark's own round goes by its shortest notation."""
    return pd.Series([round(x, 3) for x in score], dtype=float)


def report_order(pairs: DataFrame) -> DataFrame:
    """Pairs with their score rounded, in the order of the report: rounded score, then titles."""
    return pairs.withColumn("score", rounded("score")).orderBy(F.desc("score"), "title_a", "title_b", "a", "b")


def numbered_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with pair_id, 1, 2, ... in the order of their notes."""
    return numbered(pairs, "a", "b", name="pair_id").withColumn("pair_id", F.col("pair_id") + 1)


def note_by_title(notes: DataFrame) -> DataFrame:
    """title and note_id: of notes of one title the last by path."""
    return notes.groupBy("title").agg(F.max_by("note_id", F.struct("path", "note_id")).alias("note_id"))


def action_counts(actions: DataFrame) -> DataFrame:
    """Candidate pairs and how many of them merge, link or are ignored, in one row."""
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.agg(F.count("*").alias("candidates"), count("merge"), count("link"), count("ignore"))


def top_pairs(pairs: DataFrame, limit: int = 20) -> DataFrame:
    """The pairs of highest score; among equals by titles."""
    return pairs.orderBy(F.desc("score"), "title_a", "title_b", "a", "b").limit(limit)


def classify(pairs: DataFrame) -> DataFrame:
    """a, b, action, confidence and tags of pairs with their sources and tags.

    A score of 0.9 within one source merges, one of 0.8 links, others are
    ignored; merged tags are the first five of the sorted union.
    """
    same = (F.col("source_a") == F.col("source_b")) & (F.col("source_a") != "")
    action = F.when(same & (F.col("score") >= 0.9), "merge").when(F.col("score") >= 0.8, "link").otherwise("ignore")
    tags = F.slice(F.array_sort(F.array_union("tags_a", "tags_b")), 1, 5)
    return pairs.select("a", "b", action.alias("action"), F.when(action == "merge", F.least(F.lit(0.99), F.col("score") + 0.03)).alias("confidence"), F.when(action == "merge", tags).alias("tags"))


def reciprocal_links(pairs: DataFrame) -> DataFrame:
    """note_id and target: the link each note of a pair gets to the other."""
    one = pairs.select(F.col("a").alias("note_id"), F.col("title_b").alias("target"))
    return one.unionByName(pairs.select(F.col("b").alias("note_id"), F.col("title_a").alias("target"))).distinct()


def _related_keys(source: Column, title: Column, stop: list[str]) -> Column:
    tokens = F.transform(T.title_tokens(title, 4, stop), lambda t: F.concat(F.lit("w"), t))
    return F.concat(tokens, F.when(source != "", F.array(F.concat(F.lit("#"), source))).otherwise(F.array().cast("array<string>")))


def shared_keys(targets: DataFrame, notes: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """target, note, shared (tokens) and same (source) of notes that share either with a target.

    Both sides meet in an equi-join on tokens and sources; few targets, as the
    top-k of an operator are, the planner broadcasts by their size.
    """
    stop = stop or [""]
    t = targets.select(F.col("note_id").alias("target"), F.explode(_related_keys(F.col("source_doc"), F.col("title"), stop)).alias("key"))
    n = notes.select(F.col("note_id").alias("note"), F.explode(_related_keys(F.col("source_doc"), F.col("title"), stop)).alias("key"))
    met = n.join(t, "key").where("note <> target")
    return met.groupBy("target", "note").agg(F.count_if(F.col("key").startswith("w")).alias("shared"), F.max(F.col("key").startswith("#")).alias("same"))


def nearby(notes: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """target, title, score, place: the k notes nearest to each target by source (3) and shared tokens (1 each)."""
    s = shared_keys(targets, notes).select("target", "note", (3 * F.col("same").cast("int") + F.col("shared")).cast("bigint").alias("score"))
    j = s.join(notes.select(F.col("note_id").alias("note"), "title"), "note")
    w = Window.partitionBy("target").orderBy(F.desc("score"), "title", "note")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("target", "title", "score", "place")


#: Title tokens up to which all their combinations are join keys; pairs with a longer title meet by single ones.
COMBINED = 9


def nearest(notes: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """The rows of nearby for any number of targets, which are notes too.

    Of the notes that have all of a combination of tokens and source, only the
    first k + 1 by title can be among the k nearest of a target that shares
    just this combination: the others share it too and come later. So the work
    follows the combinations of the titles, not the pairs that share a token.
    """
    tokens = F.array_sort(T.title_tokens("title", 4))
    n = materialize(notes.select("note_id", "title", "source_doc", tokens.alias("tokens")), "near-notes")
    t = targets.select(F.col("note_id").alias("target")).join(n.withColumnRenamed("note_id", "target"), "target")
    short = F.size("tokens") <= COMBINED
    each = F.aggregate("tokens", F.array(F.lit("")), lambda acc, x: F.concat(acc, F.transform(acc, lambda y: F.concat(y, F.lit("\n"), x))))
    score = lambda c: F.size(F.split(c, "\n")) - 1
    plain = F.transform(each, lambda c: F.struct(c.alias("key"), score(c).alias("score")))
    sourced = F.transform(each, lambda c: F.struct(F.concat(c, F.lit("\n#"), "source_doc").alias("key"), (score(c) + 3).alias("score")))
    combined = F.filter(F.when(F.col("source_doc") != "", F.concat(plain, sourced)).otherwise(plain), lambda c: c["score"] > 0)
    first = Window.partitionBy("key").orderBy("title", "note")
    of = n.where(short).select(F.col("note_id").alias("note"), "title", F.inline(combined)).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    met = t.where(short).select("target", F.inline(combined)).join(of.select("key", "note", "title"), "key").where("note <> target").select("target", "note", "title", "score")
    # a note or a target with a long title
    one = lambda df: df.withColumn("key", F.explode(_related_keys(F.col("source_doc"), F.col("title"), [""])))
    other = n.select(F.col("note_id").alias("note"), "title", "source_doc", "tokens")
    worth = F.sum(F.when(F.col("key").startswith("#"), 3).otherwise(1)).cast("int").alias("score")
    long = [(t.where(~short), other), (t.where(short), other.where(~short))]
    for a, b in long:
        by = one(a).select("target", "key").join(one(b).select("note", "title", "key"), "key").where("note <> target")
        met = met.unionByName(by.groupBy("target", "note", "title").agg(worth))
    best = met.repartition("target").groupBy("target", "note", "title").agg(F.max("score").cast("bigint").alias("score"))
    w = Window.partitionBy("target").orderBy(F.desc("score"), "title", "note")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("target", "title", "score", "place")


def related(notes: DataFrame, targets: DataFrame, *, threshold: float = 0.34, k: int = 3) -> DataFrame:
    """target, title, score, place: the k notes most related to each target.

    Candidates share a token or the source, aren't maps of content and aren't
    linked yet. The audit score is raised by 0.08 for the same source, by up
    to 0.12 for shared tokens, and by 0.05 if the title occurs in the body.
    """
    t = targets.select(F.col("note_id").alias("target"), F.col("title").alias("t_title"), F.col("tags").alias("t_tags"), F.col("links").alias("t_links"), F.col("body").alias("t_body"))
    n = notes.where(F.col("note_type") != "moc").select(F.col("note_id").alias("note"), "title", "tags")
    j = shared_keys(targets, notes, STOP_TOKENS).join(n, "note").join(t, "target").where(~F.array_contains("t_links", F.col("title")))
    base = 0.7 * ratio(F.lower("t_title"), F.lower("title")) + 0.3 * T.jaccard("t_tags", "tags")
    more = 0.08 * F.col("same").cast("int") + F.least(F.lit(0.12), 0.04 * F.col("shared")) + 0.05 * F.contains(F.col("t_body"), F.col("title")).cast("int")
    scored = j.withColumn("score", base + more).where(F.col("score") >= threshold)
    w = Window.partitionBy("target").orderBy(F.desc("score"), "title", "note")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("target", "title", "score", "place")


def first_targets(notes: DataFrame, condition: Column, limit: int) -> DataFrame:
    """The notes of fewest words that meet a condition; among equals by title."""
    return notes.where(condition).orderBy("words", "title", "note_id").limit(limit)
