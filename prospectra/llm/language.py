"""Operator 4, LM scoring: a hierarchical Pitman-Yor model of words.

A word's restaurant is that of the word before it: every word has one of its own (START before the first), told apart by the
64 bits of hash by which words are known. All contexts share one parent, the root, whose base is non-atomic: a word never seen is
one event with the root's whole new-table mass, and the model sums to 1 over known words and unknown.

Seating is sampled by Gibbs: customers sit down one by one, then in each sweep every customer of a dish gets up and sits down
again given all others (dishes with more than STRETCH customers are seated anew in groups). Predictive probabilities are
averaged over the sweeps after the first ones. Within a sweep a restaurant's tables are estimated from its exact number of
customers and the tables for each customer in restaurants of its size; the totals that predictions use are exact sums.

One pass over the text makes chunks of documents: a row each, with distinct words and tokens as numbers of these. A chunk deals
its pairs of neighbours to word buckets as packed blobs. A word bucket has all of its words' dishes in all restaurants. The most
frequent contexts have short codes there, the others go by their hashes, so that codes only save bytes. A restaurant has as many
customers as its word has tokens (START: as many as the end), and as many tables as customers less those who share one; only
pairs that occur twice can share, so the sums over buckets are short. Answers come back by chunk: counts and sharing customers of its words
and pairs, from which the chunk's task works out the probabilities. A hot word is one key a chunk and context, so nothing is skewed
by it; what is shuffled grows with the distinct pairs.

Null and empty texts have the end token only. Without training rows every word is unknown and has probability 1. Very long
texts are one chunk's documents as any other. Repeated rows count and are scored each. An empty table gives an empty result.
Keys are integers or strings; columns other than the key, the text and those that `train` needs take no part, whatever their names.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .near import lists

#: Tokens of a chunk; documents a word bucket.
CHUNK, DOCS = 2_500_000, 4000
SWEEPS, BURN = 4, 1
#: Frequent contexts as a power of two: least and most; about CHARS characters of text to the power of 0.7.
BITS, CHARS = (10, 20), 512
#: Contexts with short codes are 2**MORE times as many, and 2**CODES at most.
MORE, CODES = 6, 18
#: Discounts and strengths of the root and of contexts.
DISCOUNT, STRENGTH = (0.6, 0.8), (1.0, 10.0)
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Customers of a dish up to which each gets up in a sweep.
STRETCH = 24


def context_bits(chars: int) -> int:
    """Frequent contexts as a power of two. All others are told apart as well: this only weighs bytes against memory."""
    return min(BITS[1], max(BITS[0], round(math.log2(max(chars, 1) ** 0.7 / CHARS))))


def seat(c: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that c customers of a dish take, in growing groups. new: (strength + discount * tables of the restaurant) * probability of the dish above it."""
    t = np.ones(len(c))
    order = np.argsort(-c, kind="stable")
    c, new = c[order], new[order]
    k = 1
    while True:
        n = int(np.searchsorted(-c, -k, side="left"))  # dishes with more than k customers
        if not n:
            break
        step = 1 if k < 64 else k // 16
        p = new[:n] / (new[:n] + k - d * t[:n])
        if step == 1:
            t[:n] += rng.random(n) < p
        else:
            t[:n] += rng.binomial(np.minimum(step, c[:n] - k).astype(np.int64), p)
        k += step
    out = np.empty(len(t))
    out[order] = t
    return out


def sit(sizes: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> None:
    """One more customer for each row of table sizes: at a table by its size less the discount, or at a new one."""
    weight = np.where(sizes > 0, sizes - d, 0.0)
    pick = rng.random(len(sizes)) * (weight.sum(1) + new)
    at = (np.cumsum(weight, 1) <= pick[:, None]).sum(1)
    fresh = at >= sizes.shape[1]
    at[fresh] = (sizes[fresh] == 0).argmax(1)  # a row has as many places as customers, and one of them stands
    sizes[np.arange(len(sizes)), at] += 1


def get_up(sizes: np.ndarray, rng: np.random.Generator) -> None:
    """One customer of each row, any with the same chance, leaves."""
    at = (np.cumsum(sizes, 1) <= (rng.random(len(sizes)) * sizes.sum(1))[:, None]).sum(1)
    sizes[np.arange(len(sizes)), at] -= 1


class Dishes:
    """All restaurants' dishes that are words of one bucket. words: hashes; w: place of each pair's word; u: number of its context, below 2**bits."""

    def __init__(self, words: np.ndarray, w: np.ndarray, u: np.ndarray, counts: np.ndarray, bits: int = 20):
        self.bits = bits
        self.all, at = np.unique(words, return_inverse=True)
        pair = (at[w].astype(np.int64) << bits) | u
        pairs, to = np.unique(pair, return_inverse=True)
        c = np.bincount(to, counts, len(pairs))
        self.asked, self.to = pairs, to  # the pairs of all chunks, whether they were trained or not
        self.known = np.bincount(pairs >> bits, c, len(self.all))
        self.own = np.flatnonzero(c)
        self.w, self.u, self.c2 = pairs[self.own] >> bits, pairs[self.own] & ((1 << bits) - 1), c[self.own]

    def sweeps(self, c2: np.ndarray, root: float, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tables of each dish and customers of each word at the root, after each of the later sweeps. The same seed gives the same seating again.

        c2: customers of each context, over all buckets (of those with a dish that has two, at least); root: how many times the root's customers are those of this bucket's words.
        """
        rng = np.random.default_rng(seed)
        (d0, d2), (s0, s2) = DISCOUNT, STRENGTH
        size = np.log2(np.maximum(c2, 1)).astype(np.int64)  # contexts by how many customers they have
        kind, mine = size[self.u], self.c2
        seats = np.bincount(kind, mine, 64)
        few = {int(c): np.flatnonzero(mine == c) for c in np.unique(mine) if 1 < c <= STRETCH}
        many = np.flatnonzero(mine > STRETCH)
        t2 = np.ones(len(mine))
        state = {c: np.zeros((len(at), c)) for c, at in few.items()}
        for sweep in range(-1, SWEEPS):
            c0 = np.bincount(self.w, t2, len(self.all))
            if sweep >= BURN:
                yield t2.copy(), c0
            if sweep == SWEEPS - 1:
                break
            p0 = np.maximum(c0 - d0, 1e-12) / (s0 + root * c0.sum())
            tables = (np.bincount(kind, t2, 64) / np.maximum(seats, 1))[size] * c2
            new = (s2 + d2 * tables[self.u]) * p0[self.w]
            for c, at in few.items():
                for _ in range(c):
                    if sweep >= 0:
                        get_up(state[c], rng)
                    sit(state[c], new[at], d2, rng)
                t2[at] = (state[c] > 0).sum(1)
            t2[many] = seat(mine[many], new[many], d2, rng)

    def predict(self, c2: np.ndarray, totals: list[tuple[float, np.ndarray]], words: float, root: float, seed: int) -> np.ndarray:
        """Predictive probability of each pair asked for, averaged over the sweeps.

        totals: for each sweep the root's customers and all tables of each context; words: known ones. With these sums over
        all buckets the probabilities of known words and of unknown add up to 1 in each sweep.
        """
        w, u = self.asked >> self.bits, self.asked & ((1 << self.bits) - 1)
        total = np.zeros(len(w))
        for (t2, c0), (every, all2) in zip(self.sweeps(c2, root, seed), totals, strict=True):
            rest = np.zeros(len(w))
            rest[self.own] = self.c2 - DISCOUNT[1] * t2
            total += chance(rest, all2[u], c2[u], at_root(self.known[w], c0[w], words, every))
        return total / len(totals)


def at_root(known: np.ndarray, c0: np.ndarray, words: float, every: float) -> np.ndarray:
    """A word's probability at the root, which has `every` customers; one that isn't known has all that is left beside the known ones."""
    return np.where(known > 0, c0 - DISCOUNT[0], STRENGTH[0] + DISCOUNT[0] * words) / (STRENGTH[0] + every)


def chance(rest: np.ndarray, tables: np.ndarray, customers: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A dish's probability in its restaurant. rest: its customers less the discounts of its tables; above: its probability at the root."""
    return (rest + (STRENGTH[1] + DISCOUNT[1] * tables) * above) / (STRENGTH[1] + customers)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the low bytes of all first: high ones compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def from_planes(data: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, size * n, at).reshape(size, n).T).view(kind)[:, 0]


def pack(words: np.ndarray, w: np.ndarray, u: np.ndarray, counts: np.ndarray, wide: bool) -> tuple[bytes, bytes]:
    """Words (sorted: their steps) with the number of their contexts; contexts with their counts (those of 255 and more once more, in full)."""
    n = np.bincount(w, minlength=len(words)).astype("<u4")
    large = counts >= 255
    a = np.array([len(words)], "<u4").tobytes() + planes(np.diff(words, prepend=np.uint64(0)).astype("<u8")) + planes(n)
    b = planes(u.astype("<u4" if wide else "<u2")) + np.minimum(counts, 255).astype("u1").tobytes() + counts[large].astype("<u4").tobytes()
    return zlib.compress(a, 1), zlib.compress(b, 1)


def unpack_words(a: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words, and how many contexts each has."""
    a = zlib.decompress(a)
    n = int(np.frombuffer(a, "<u4", 1)[0])
    return np.cumsum(from_planes(a, "<u8", n, 4), dtype=np.uint64), from_planes(a, "<u4", n, 4 + 8 * n)


def unpack(a: bytes, b: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, each = unpack_words(a)
    b = zlib.decompress(b)
    pairs, width = int(each.sum()), 4 if wide else 2
    u = from_planes(b, f"<u{width}", pairs, 0)
    counts = np.frombuffer(b, "u1", pairs, width * pairs).astype(np.int64)
    counts[counts == 255] = np.frombuffer(b, "<u4", offset=(width + 1) * pairs)
    return words, np.repeat(np.arange(len(words)), each), u.astype(np.int64), counts


def three(x: np.ndarray) -> bytes:
    """Numbers below 2**24 in three bytes each, the low bytes of all first, compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes(), 1)


def from_three(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(3, -1).T
    return out.view("<u4")[:, 0]


def numbers(x: np.ndarray) -> bytes:
    """Whole numbers, small ones in one byte."""
    return np.minimum(x, 255).astype("u1").tobytes() + x[x >= 255].astype("<u8").tobytes()


def from_numbers(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """n numbers, and where the next ones begin."""
    out = np.frombuffer(data, "u1", n, at).astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(data, "<u8", len(large), at + n)
    return out, at + n + 8 * len(large)


def hashes(x: np.ndarray) -> bytes:
    """Hashes in ascending runs, as steps."""
    return zlib.compress(planes(np.diff(x, prepend=np.uint64(0)).astype("<u8")), 1)


def from_hashes(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    return np.cumsum(from_planes(data, "<u8", len(data) // 8, 0), dtype=np.uint64)


class Chunk:
    """The tokens of some documents. words: distinct ones, about by falling frequency; contexts: these and START; c: training tokens of each word."""

    def __init__(self, words: bytes, tokens: bytes, each: np.ndarray, trained: np.ndarray):
        self.words, self.tokens, self.each = from_hashes(words), from_three(tokens).view(np.int32), each
        self.first = np.concatenate([[0], np.cumsum(each)[:-1]])
        self.trained = np.repeat(trained, each)
        self.c = np.bincount(self.tokens[self.trained], minlength=len(self.words))
        self.end = int(np.flatnonzero(self.words == END)[0])
        self.contexts = np.concatenate([self.words, [START]])
        self.before = np.empty(len(self.tokens), np.int32)
        self.before[1:] = self.tokens[:-1]
        self.before[self.first] = len(self.words)

    def customers(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts with their customers: each token but the end has one after it."""
        c = np.concatenate([self.c, self.c[[self.end]]])
        c[self.end] = 0
        at = np.flatnonzero(c)
        return self.contexts[at], c[at]

    def rare(self, frequent: np.ndarray) -> np.ndarray:
        """Which contexts are not among the frequent ones (sorted)."""
        return ~np.isin(self.contexts, frequent)

    def deal(self, bits: int) -> None:
        """Distinct pairs of a word (its place by hash) and a context, by word; cuts and places: where the buckets' words and pairs begin."""
        order = np.argsort(self.words)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.by_hash = self.words[order]
        pairs, at = np.unique((self.place[self.tokens] << 24) | self.before, return_inverse=True)
        self.at = at.astype(np.int32)
        self.w, self.u = pairs >> 24, pairs & 0xFFFFFF
        cuts = np.searchsorted(self.by_hash, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        self.cuts = np.concatenate([[0], cuts, [len(order)]])
        self.places = np.searchsorted(self.w, self.cuts)


def lower_words(text: Column) -> Column:
    """Hashes of the words after A-Z became a-z."""
    return F.transform(C.words(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)), lambda x: F.xxhash64(x))


def score(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id", seed: int = 11) -> DataFrame:
    """key, trained, n_tokens, n_known, train_tokens, base_score and score (log10) of every document; learns from those where train is true."""
    spark = docs.sparkSession
    C.ship(spark)
    count, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    bits = max(3, math.ceil(math.log2(max(count, 1) / DOCS + 1)))
    codes, buckets = 1 << min(CODES, context_bits(chars) + MORE), 1 << bits
    kind = docs.schema[key].dataType.simpleString()
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    if kind not in kinds:
        raise ValueError(f"keys of type {kind} are neither integers nor strings")
    rows = docs.select(F.col(key).alias("k"), F.coalesce(train, F.lit(False)).alias("train"), lower_words(C.clean(text)).alias("h"))
    schema = pa.schema([("chunk", pa.int64()), ("k", pa.list_(kinds[kind])), ("train", pa.list_(pa.bool_())), ("n", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        names: list = []
        trained: list[bool] = []
        tokens: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            each = [len(x) for x in tokens]
            flat = np.concatenate(tokens)
            tokens.clear()  # what is large goes as soon as it has served
            words, w, n = np.unique(flat, return_inverse=True, return_counts=True)
            del flat
            if len(words) >= (1 << 24) - 1:
                raise ValueError("a chunk has too many distinct words")
            order = np.argsort(-np.log2(n).astype(np.int64), kind="stable")  # frequent words have low numbers, which compress well
            to = np.empty(len(order), np.uint32)
            to[order] = np.arange(len(order), dtype=np.uint32)
            out = (number, names, trained, each, hashes(words[order]), three(to[w]))
            got = pa.RecordBatch.from_pylist([dict(zip(schema.names, out, strict=True))], schema=schema)
            number, size = number + 1, 0
            names.clear()
            trained.clear()
            return got

        for batch in batches:
            for k, t, h in zip(batch.column("k").to_pylist(), batch.column("train").to_pylist(), lists(batch.column("h")), strict=True):
                names.append(k)
                trained.append(t)
                tokens.append(np.concatenate([h.view(np.uint64), [END]]))
                size += len(h) + 1
                if size >= CHUNK:
                    yield flush()
        if tokens:
            yield flush()

    parts = C.written(rows.mapInArrow(C.lean(chunks), f"chunk long, k array<{kind}>, train array<boolean>, n array<int>, words binary, tokens binary"), "chunks")

    def of_chunks(what: Callable[[int, Chunk], Iterator[pa.RecordBatch]], names: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    n, t = (row.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("n", "train"))
                    yield from what(row.column("chunk")[0].as_py(), Chunk(row.column("words")[0].as_py(), row.column("tokens")[0].as_py(), n, t))

        return parts.select("chunk", "train", "n", "words", "tokens").mapInArrow(C.lean(run), names)

    def table(**columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in columns.items()})

    def customers(_: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        u, n = chunk.customers()
        yield table(u=u, n=n)

    contexts = C.written(of_chunks(customers, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")), "contexts")
    types, tokens_all = (float(x or 0) for x in contexts.agg(F.count("*"), F.sum("n")).first())  # START stands for the end
    level = F.round(64 * F.log2("n")).cast("int")
    levels = sorted(contexts.groupBy(level.alias("at")).agg(F.count("*").alias("n")).collect(), reverse=True)  # at most 64 a doubling
    cut = min((r["at"] for r, n in zip(levels, np.cumsum([r["n"] for r in levels]), strict=True) if n <= codes), default=64 * 64)
    top = contexts.where(level >= cut)  # at most 2**CODES rows
    at_top = top.toArrow().sort_by([("n", "descending"), ("u", "ascending")])
    by_rank, c_top = at_top.column("u").to_numpy().view(np.uint64), at_top.column("n").to_numpy().astype(float)
    codes = len(by_rank)
    code = np.argsort(by_rank)
    frequent = by_rank[code]

    def asks(_: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        """Contexts without codes whose customers have dishes in a bucket."""
        rare = chunk.rare(frequent)
        at = np.flatnonzero(rare[chunk.before] & chunk.trained)
        bucket = (chunk.words >> np.uint64(64 - bits)).astype(np.int64)
        b, u = np.divmod(np.unique(bucket[chunk.tokens[at]] << 24 | chunk.before[at]), 1 << 24)
        yield table(bucket=b.astype(np.int32), u=chunk.contexts[u])

    def wanted(chunk_number: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        u = chunk.contexts[chunk.rare(frequent)]
        yield table(chunk=np.full(len(u), chunk_number), u=u)

    def blobs(chunk_number: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        chunk.deal(bits)
        counts = np.bincount(chunk.at[chunk.trained], minlength=len(chunk.w))
        rare = chunk.rare(frequent)
        short = np.zeros(len(rare), np.int64)
        short[~rare] = code[np.searchsorted(frequent, chunk.contexts[~rare])]
        out = []
        for b in range(buckets):
            x, y = slice(chunk.cuts[b], chunk.cuts[b + 1]), slice(chunk.places[b], chunk.places[b + 1])
            if x.start < x.stop:
                u = chunk.u[y]
                some = rare[u]
                own, at = np.unique(chunk.contexts[u[some]], return_inverse=True)
                u = short[u]
                u[some] = codes + at
                wide = codes + len(own) > 1 << 16
                out.append((b, chunk_number, wide, *pack(chunk.by_hash[x], chunk.w[y] - x.start, u, counts[y], wide), hashes(own)))
        names = ("bucket", "chunk", "wide", "a", "b", "x")
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)), schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("wide", pa.bool_()), *((x, pa.binary()) for x in names[3:])]))

    many = contexts.where((level < cut) & (F.col("n") > 1))  # a single customer shares no table
    sizes = of_chunks(asks, "bucket int, u long").distinct().join(many.hint("merge"), "u")

    def seated(group: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        """Answers to each chunk; with chunk -1 the customers of each context who share a table (END: the root's customers), for each later sweep."""
        got = [unpack(*x) for x in zip(group["a"], group["b"], group["wide"], strict=True)]
        lone = [from_hashes(x) for x in group["x"]]
        rare = np.unique(np.concatenate(lone)) if lone else np.zeros(0, np.uint64)
        n = [len(g[0]) for g in got]
        first = np.cumsum([0, *n[:-1]])
        u = [np.concatenate([np.arange(codes), codes + np.searchsorted(rare, own)])[g[2]] for g, own in zip(got, lone, strict=True)]
        wide = max(20, (codes + len(rare)).bit_length())
        dishes = Dishes(np.concatenate([g[0] for g in got]), np.concatenate([g[1] + f for g, f in zip(got, first, strict=True)]), np.concatenate(u), np.concatenate([g[3] for g in got]), wide)
        c2 = np.concatenate([c_top, np.ones(len(rare))])
        c2[codes + np.searchsorted(rare, sizes["u"].to_numpy().view(np.uint64))] = sizes["n"].to_numpy()
        share, root = [], []
        for t2, c0 in dishes.sweeps(c2, float(buckets), seed):
            share.append(np.round(dishes.c2 - t2))
            root.append(np.round(c0))
        c = np.zeros(len(dishes.asked), np.int64)
        c[dishes.own] = dishes.c2
        e = np.zeros(len(dishes.asked), np.int64)
        e[dishes.own] = sum(share)
        out = []
        cut = np.cumsum([len(g[2]) for g in got])
        for chunk, bucket, g, to in zip(group["chunk"], group["bucket"], got, np.split(dishes.to, cut[:-1]), strict=True):
            at = np.searchsorted(dishes.all, g[0])
            known = dishes.known[at].astype(np.int64)
            out.append((chunk, bucket, zlib.compress(b"".join([numbers(known), *(numbers(known - x[at].astype(np.int64)) for x in root), numbers(c[to]), numbers(e[to])]), 1)))
        sums = np.array([np.bincount(dishes.u, x, len(c2)) for x in share]).astype(np.int64)
        at = np.flatnonzero(sums.any(0))
        keys = np.concatenate([np.concatenate([by_rank, rare])[at], [END]])
        sums = np.concatenate([sums[:, at], np.array([x.sum() for x in root], np.int64)[:, None]], 1)
        out.append((-1, int(group["bucket"].iloc[0]), zlib.compress(keys.tobytes() + sums.astype("<i8").tobytes(), 1)))
        return pd.DataFrame(out, columns=["chunk", "bucket", "a"])

    def lean_pair(run: Callable) -> Callable:
        def one(left: object, right: object) -> object:
            return next(C.lean(lambda _: iter([run(left, right)]))(iter(())))

        return one

    dealt = of_chunks(blobs, "bucket int, chunk long, wide boolean, a binary, b binary, x binary")
    answers = C.written(dealt.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInPandas(lean_pair(seated), "chunk long, bucket int, a binary"), "answers")
    named = ", ".join(f"e{s} long" for s in range(SWEEPS - BURN))

    def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column("a").to_pylist():
                x = np.frombuffer(zlib.decompress(a), "<i8").reshape(SWEEPS - BURN + 1, -1)
                yield table(u=x[0], **{f"e{s}": e for s, e in enumerate(x[1:])})

    sums = [f"e{s}" for s in range(SWEEPS - BURN)]
    shared = C.written(answers.where("chunk = -1").mapInArrow(C.lean(sharing), f"u long, {named}").groupBy("u").agg(*(F.sum(x).alias(x) for x in sums)), "sharing")
    end = F.col("u") == F.lit(int(END.view(np.int64)))
    at_top = shared.join(top.select("u").hint("merge"), "u").unionByName(shared.where(end)).toArrow()
    keys = at_top.column("u").to_numpy().view(np.uint64)
    e_at = np.array([at_top.column(x).to_numpy() for x in sums]).reshape(len(sums), len(keys))
    every = e_at[:, keys == END].sum(1)
    e_top = np.zeros((len(sums), codes))
    back = keys != END
    e_top[:, np.searchsorted(frequent, keys[back])] = e_at[:, back]

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: a chunk; right: its answers by bucket, and (bucket -1) its other contexts' customers who share a table."""
        row = left.combine_chunks()
        keys, trained, each = (row.column(x).combine_chunks().flatten() for x in ("k", "train", "n"))
        chunk = Chunk(row.column("words")[0].as_py(), row.column("tokens")[0].as_py(), each.to_numpy(), trained.to_numpy(zero_copy_only=False))
        chunk.deal(bits)
        c = np.zeros(len(chunk.words), np.int64)
        e0 = np.zeros((len(sums), len(c)), np.int64)
        own = np.zeros((2, len(chunk.w)), np.int64)
        bucket = right.column("bucket").to_numpy()
        for i in np.flatnonzero(bucket >= 0):
            b, data = bucket[i], zlib.decompress(right.column("a")[int(i)].as_py())
            x, y = slice(chunk.cuts[b], chunk.cuts[b + 1]), slice(chunk.places[b], chunk.places[b + 1])
            c[x], at = from_numbers(data, x.stop - x.start, 0)
            for e in e0:
                e[x], at = from_numbers(data, x.stop - x.start, at)
            for e in own:
                e[y], at = from_numbers(data, y.stop - y.start, at)
        customers = np.concatenate([c[chunk.place], c[chunk.place[[chunk.end]]]])
        rare = chunk.rare(frequent)
        e2 = np.zeros((len(sums), len(rare)))
        e2[:, ~rare] = e_top[:, np.searchsorted(frequent, chunk.contexts[~rare])]
        other = np.flatnonzero(bucket < 0)
        if len(other):
            order = np.argsort(chunk.contexts)
            at = order[np.searchsorted(chunk.contexts, right.column("u").to_numpy()[other].view(np.uint64), sorter=order)]
            for s, x in enumerate(sums):
                e2[s, at] = right.column(x).to_numpy()[other]
        rest = (1 - DISCOUNT[1]) * own[0] + DISCOUNT[1] / len(sums) * own[1]
        p = np.zeros(len(chunk.w))
        for s in range(len(sums)):
            above = at_root(c, c - e0[s], types, float(every[s]))[chunk.w]
            p += chance(rest, (customers - e2[s])[chunk.u], customers[chunk.u], above)
        word = chunk.place[chunk.tokens]
        base = np.log10((c + 0.5) / (tokens_all + 0.5 * (types + 1)))[word]
        add = lambda x: np.add.reduceat(x, chunk.first)
        out = [keys, trained, pa.array(chunk.each.astype(np.int64)), pa.array(add((c[word] > 0).astype(np.int64))), pa.array(np.full(len(keys), int(tokens_all))), pa.array(add(base)), pa.array(add(np.log10(p / len(sums))[chunk.at]))]
        return pa.Table.from_arrays(out, names=["k", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    zero = [F.lit(0).cast("long").alias(x) for x in ("u", *sums)]
    found = answers.where("chunk >= 0").select("chunk", "bucket", "a", *zero)
    lone = of_chunks(wanted, "chunk long, u long").join(shared.where(~end).hint("merge"), "u")
    found = found.unionByName(lone.select("chunk", F.lit(-1).alias("bucket"), F.lit(b"").alias("a"), "u", *sums))
    out = parts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lean_pair(total), f"k {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("k", key)
