"""Operator 2, suffix-array dedup: depth-limited most-significant-digit passes over the suffixes of all texts.

Suffixes start at tokens, which are bytes or words, and are told apart only up to `length` tokens, by passes over digits; a
suffix that is alone in its group after a pass is dropped, and groups that are equal after the last pass are exactly the
windows that repeat. A row for each suffix would be many times the text, so the first digits are taken of runs of suffixes:

1. The first digit of a window is its anchor gram: of the strings of `gram` tokens in the window the first whose hash is
   smallest. Equal windows have equal anchors at equal places, and neighbouring windows share theirs, so that one row
   stands for a run of many suffixes. Runs whose gram occurs once are done: nothing in them repeats.
2. The second digit is the whole stretch of text under a run. If all runs of a gram have the same stretch, or a run's
   stretch occurs twice, all its windows repeat. One run of each stretch goes on.
3. The windows of those, one by one, go through passes over their own digits from the front (DIGITS tokens, a quarter of
   the length, and so on to `length`), within a gram: in one task for up to HOT runs, and beyond that by a shuffle on
   (gram, window) that aggregates before it sends.

Digits are 64-bit hashes (each pass compares within groups of the former, so 128 bits and more part windows).
Matches never cross texts. Null and empty texts have no tokens and lose nothing; so do texts shorter than a window. Repeated
rows are copies of each other. Very long texts are read whole: memory of a task grows with the longest single text (about 60
bytes a byte), not with groups. An empty table gives an empty result. Other columns come out as they went in, whatever their
names; one that has the name of a result column raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .near import mix

#: Tokens of a window and of an anchor gram, by kind of token.
LENGTH, GRAM = 400, 200
WORDS, WORD_GRAM = 50, 20
#: Tokens of a window that the first passes compare.
DIGITS = (8, 32, 100)
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
#: Runs of a gram that one task compares, and rows that it takes up at a time.
HOT = 2000
TOGETHER = 4000
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, np.uint64(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


class Rolling:
    """Hashes of substrings of a sequence of numbers from prefix sums of a polynomial modulo 2**64, mixed."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        power, self.inverse = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * power[: self.n], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Of each substring of so many bytes."""
        return mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: self.n - size + 1])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def tokens(data: np.ndarray, words: bool) -> tuple[Rolling, np.ndarray | None, np.ndarray | None]:
    """Hashes over a text's tokens, and the places of their first bytes and of the bytes after them (None: every byte is one)."""
    roll = Rolling(_BYTES[data])
    if not words:
        return roll, None, None
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return Rolling(roll.some(start, end)), start, end


def anchors(roll: Rolling, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor of every window: the first of the grams in it whose hash is smallest. Places, first and last window, hashes."""
    grams = roll.all(gram)
    wide = length - gram + 1
    n = len(grams)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    whole = -(-n // wide) * wide
    padded = np.full(whole, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = packed
    ahead = np.minimum.accumulate(padded.reshape(-1, wide), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(-1, wide)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - wide + 1], ahead[wide - 1 : n]) & np.uint64(0xFFFFFFFF)
    cut = np.flatnonzero(np.diff(least)) + 1
    low = np.concatenate([[0], cut])
    high = np.concatenate([cut - 1, [len(least) - 1]])
    at = least[low].astype(np.int64)
    return at, low, high, grams[at]


def runs(docs: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    """key, stretch, r, lo, hi, s, e for every run of windows with one anchor: first and last window, bytes under them; docs: r, t."""
    schema = "key long, stretch long, r long, lo int, hi int, s int, e int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out = []
                for r, t in zip(batch.column("r").to_pylist(), batch.column("t"), strict=True):
                    data = np.frombuffer(t.as_buffer() or b"", np.uint8) if t.is_valid else np.zeros(0, np.uint8)
                    if len(data) < length:
                        continue
                    roll, start, end = tokens(data, words)
                    if roll.n < length:
                        continue
                    at, low, high, key = anchors(roll, length, gram)
                    last = high + length
                    places = (low, last) if start is None else (start[low], end[last - 1])
                    out.append((key, mix(roll.some(low, last) + (at - low).astype(np.uint64)), np.full(len(at), r), low, high, *places))
                if out:
                    key, stretch, r, *numbers = map(np.concatenate, zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(r, pa.int64()), *(pa.array(x.astype(np.int32)) for x in numbers)], names=["key", "stretch", "r", "lo", "hi", "s", "e"])

    return docs.select("r", F.col("t").cast("binary").alias("t")).mapInArrow(C.lean(scan), schema)


def windows(group: pd.DataFrame, length: int, words: bool) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the stretches of some runs: hashes, and for each window its row, its place among the tokens, its first byte and the one after it."""
    x = group["x"].to_numpy()
    gap = b" " if words else b""
    roll, start, end = tokens(np.frombuffer(gap.join(x), np.uint8), words)
    ends = np.cumsum([len(t) + len(gap) for t in x])
    if start is None:
        start, end = np.arange(roll.n), np.arange(1, roll.n + 1)
    owner = np.searchsorted(ends, start, side="right")
    whole = np.flatnonzero(owner[: max(0, roll.n - length + 1)] == owner[length - 1 :])  # windows within one stretch
    row = owner[whole]
    first = group["s"].to_numpy()[row] - (ends[row] - [len(t) + len(gap) for t in x[row]] if len(row) else 0)
    return roll, row, whole, start[whole] + first, end[whole + length - 1] + first


def passes(roll: Rolling, place: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which windows are equal to another of their group, by passes over digits from the front."""
    live = np.arange(len(place))
    before = 0
    for depth in (*(d for d in DIGITS if d < length), length):
        digit = roll.some(place[live] + before, place[live] + depth)
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        number = np.cumsum(new) - 1
        more = np.bincount(number)[number] > 1
        live, group, before = live[more], number[more], depth
        if not len(live):
            break
    out = np.zeros(len(place), bool)
    out[live] = True
    return out


def spans(group: pd.DataFrame, row: np.ndarray, hit: np.ndarray, s: np.ndarray, e: np.ndarray) -> pd.DataFrame:
    """Byte spans under the windows hit."""
    at = np.flatnonzero(hit)
    if not len(at):
        return pd.DataFrame({"r": [], "s": [], "e": []}).astype({"r": "int64", "s": "int32", "e": "int32"})
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(row[at]) > 0))
    low, high = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return pd.DataFrame({"r": group["r"].to_numpy()[row[low]], "s": s[low], "e": e[high]}).astype({"r": "int64", "s": "int32", "e": "int32"})


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: bool = False) -> DataFrame:
    """r, s, e: spans of bytes that windows cover which start anywhere else too; docs: r, t."""
    C.ship(docs.sparkSession)
    every = C.written(runs(docs, length, gram, words), "runs", rows=2 * docs.count())
    few = every.count() // 4  # rows of the tables to come, about
    keys = every.groupBy("key").agg(F.count("*").alias("n"), F.min("stretch").alias("a"), F.max("stretch").alias("b")).where("n > 1")
    keys = C.written(keys.select("key", (F.col("a") == F.col("b")).alias("alike")), "grams", rows=few // 4)
    left = C.written(every.join(C.small(keys), "key"), "digits", rows=few)
    out = left.where("alike").select("r", "s", "e")
    other = left.where("not alike")
    kinds = C.written(other.groupBy("key", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("r", "lo", "s", "e")).alias("one")), "stretches", rows=few // 4)
    out = out.unionByName(other.join(C.small(kinds.where("n > 1").select("key", "stretch")), ["key", "stretch"], "left_semi").select("r", "s", "e"))
    groups = kinds.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("least = 1")
    chosen = C.written(kinds.join(C.small(groups), "key").select("key", "n", "m", "one.*"), "chosen", rows=few // 4)
    text = docs.select("r", F.col("t").cast("binary").alias("t"))
    text = text.join(C.small(chosen), "r").select("key", "n", "m", "r", "lo", "s", F.expr("substring(t, s + 1, e - s)").alias("x")).dropDuplicates(["key", "r", "lo"])
    text = C.written(text, "texts", rows=few // 4)

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(group: pd.DataFrame) -> pd.DataFrame:
            with np.errstate(over="ignore"):
                roll, row, place, s, e = windows(group, length, words)
                hit = passes(roll, place, group["key"].to_numpy()[row], length)
                return spans(group, row, hit & (group["n"].to_numpy()[row] == 1), s, e)

        rest: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            rest.append(batch)
            n += len(batch)
            if n > TOGETHER:
                whole = pd.concat(rest, ignore_index=True)
                open_key = whole["key"].to_numpy() == whole["key"].iloc[-1]  # more rows of the last key may follow
                if not open_key.all():
                    yield done(whole[~open_key].reset_index(drop=True))
                rest = [whole[open_key]]
                n = len(rest[0])
        if n:
            yield done(pd.concat(rest, ignore_index=True))

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                roll, row, place, s, e = windows(batch, length, words)
                h = roll.some(place, place + length).view(np.int64)
                yield pd.DataFrame({"key": batch["key"].to_numpy()[row], "h": h, "n": batch["n"].to_numpy()[row], "r": batch["r"].to_numpy()[row], "s": s.astype(np.int32), "e": e.astype(np.int32)})

    usual = text.where(f"m <= {HOT}").repartition("key").sortWithinPartitions("key").mapInPandas(C.lean(within), "r long, s int, e int")
    out = out.unionByName(usual)
    if groups.where(f"m > {HOT}").limit(1).count():
        many = C.written(text.where(f"m > {HOT}").mapInPandas(C.lean(single), "key long, h long, n long, r long, s int, e int"), "hot")
        again = many.groupBy("key", "h").agg(F.count("*").alias("c")).where("c > 1").select("key", "h")
        hot = many.where("n = 1").join(C.small(again), ["key", "h"], "left_semi")
        out = out.unionByName(hot.select("r", "s", "e"))
    return out


def merged(found: DataFrame) -> DataFrame:
    """r and spans, an array of (s, e): the maximal spans under those found. A text's spans are merged while they are sorted, not gathered first."""
    by = Window.partitionBy("r").orderBy("s", "e")
    ends = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("first", (ends.isNull() | (F.col("s") > ends)).cast("int"))
    rows = rows.withColumn("number", F.sum("first").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("r", "number").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return rows.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, words: bool = False) -> DataFrame:
    """All columns of docs, the text without its repeated bytes (decoded; a sign that a cut breaks is dropped), and
    n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes). length and gram count bytes, or words."""
    C.refuse(docs, *RESULTS)
    names = [c for c in docs.columns if c != text]
    whole = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)), C.clean(docs[text]).alias("t"))
    whole = whole.withColumn("r", F.xxhash64(*(c for c, kind in whole.dtypes if not kind.startswith("map"))))
    joined = whole.join(merged(repeated(whole.select("r", "t"), length, gram, words)), "r", "left").drop("r")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, gone, count, sha = [], [], [], [], []
            for t, spans in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = t.encode()
                ends = [0, *(x for span in spans or [] for x in (span["s"], span["e"])), len(data)]
                left = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                texts.append(left.decode(errors="ignore"))
                size.append(len(data))
                gone.append(len(data) - len(left))
                count.append(len(spans or []))
                sha.append(hashlib.sha256(left).hexdigest())
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names=[*(f"c{i}" for i in range(len(names))), "t", *RESULTS])

    kinds = dict(whole.dtypes)
    schema = ", ".join([*(f"c{i} {kinds[f'c{i}']}" for i in range(len(names))), "t string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    out = joined.select(*(f"c{i}" for i in range(len(names))), "t", "spans").mapInArrow(C.lean(cut), schema)
    back = [F.col("t").alias(text) if c == text else F.col(f"c{names.index(c)}").alias(c) for c in docs.columns]
    return out.select(*back, *RESULTS)
