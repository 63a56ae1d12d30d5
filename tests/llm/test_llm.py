import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prospectra.llm import language, licences, mixing, near, packing, pages, quality, queries, repeats, rules, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_mixture(spark, docs, none):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"))
    got = mixing.mix(many, {"big": 0.5, "small": 0.5}).groupBy("source").count().collect()
    assert all(1850 < r["count"] < 2150 for r in got) and len(got) == 2
    one, two = (sorted(map(tuple, mixing.mix(docs.repartition(n), {"s0": 3.0, "s1": 1.0}, 0.5, 2.0).select("doc_id", "copy", "mix_key").collect())) for n in (1, 5))
    assert one == two and mixing.mix(none, {"s0": 1.0}).count() == 0
    assert mixing.mix(many.where("doc_id = 5 OR doc_id > 3000"), {"big": 1.0}, 0.0, 3.0).groupBy("doc_id").count().first()["count"] > 2500


def test_repeats_against_brute_force(docs, rows, none, monkeypatch):
    for hot in (2000, 1):
        monkeypatch.setattr(repeats, "HOT", hot)
        got = table(repeats.remove_repeats(docs))
        data = {r[0]: (r[1] or "").encode() for r in rows}
        seen = collections.Counter(b[i : i + 400] for b in data.values() for i in range(len(b) - 399))
        for k, b in data.items():
            mark = np.zeros(len(b), bool)
            for i in range(len(b) - 399):
                if seen[b[i : i + 400]] > 1:
                    mark[i : i + 400] = True
            left = bytes(np.frombuffer(b, np.uint8)[~mark])
            spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
            assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), int(mark.sum()), spans, hashlib.sha256(left).hexdigest())
    assert got[0].id == "clash" and repeats.remove_repeats(none).count() == 0


def test_jaccard_against_brute_force(docs, rows, none):
    sets = {}
    for k, t, *_ in rows:
        w = WORD.findall(t or "")
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    got = table(near.jaccard_join(docs))
    for a, x in sets.items():
        assert got[a].n_links == sum(a != b and len(x & y) >= 0.8 * len(x | y) for b, y in sets.items() if x and y)
    assert [got[k].component_id for k in (0, 1, 2)] == [0, 0, 0] and not got[2].kept and got[3].kept
    left = near.deduplicate(docs.unionByName(docs.limit(1)))
    assert sorted(r.doc_id for r in left.collect()) == [0, *range(3, 13)] and left.columns == docs.columns
    assert near.jaccard_join(none).count() == 0


def test_join_with_shared_boilerplate(spark, monkeypatch):
    """Unlike texts that share a passage, and groups of near copies: buckets are split by size, and recall holds."""
    import random

    dice = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: [dice.choice(words) for _ in range(n)]
    shared, texts = prose(60), []
    for i in range(260):
        texts.append(shared + prose(dice.randint(60, 120)))
    for _ in range(12):
        base = prose(150)
        for _ in range(dice.randint(2, 25)):
            copy = list(base)
            for _ in range(dice.randint(0, 6)):
                copy[dice.randrange(len(copy))] = dice.choice(words)
            texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = {i: sum(i != j and len(x & y) >= 0.8 * len(x | y) - 1e-9 for j, y in enumerate(sets)) for i, x in enumerate(sets)}
    df = spark.createDataFrame([(f"x{i:04d}", " ".join(t)) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    for group, size in ((512, 400_000), (8, 2000)):
        monkeypatch.setattr(near, "GROUP", group)
        monkeypatch.setattr(near, "SHINGLES", size)
        got = table(near.jaccard_join(df))
        assert sum(got[f"x{i:04d}"].n_links for i in want) >= 0.99 * sum(want.values()) and all(got[f"x{i:04d}"].n_links <= n for i, n in want.items())
    assert near.deduplicate(df).count() >= 260 + 12


def test_rows_with_one_key_and_other_texts(spark):
    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, other), (2, text), (3, other), (3, other), (None, "x y z")], "doc_id long, text string")
    left = near.deduplicate(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(0, "x y z"), (1, text), (1, other)])
    assert sorted(r.n_links for r in near.jaccard_join(df).collect()) == [0, 1, 1, 2, 2, 2]


def test_joins_that_shuffle_agree(spark, docs, none, monkeypatch):
    """With nothing broadcast by size: the plans of large tables."""
    import prospectra.llm.common as C

    plain = lambda df: sorted(tuple(str(x) for x in r) for r in df.collect())
    runs = {
        "op2": lambda: plain(repeats.remove_repeats(docs)), "words": lambda: plain(repeats.remove_repeats(docs, length=50, gram=20, words=True)),
        "op8": lambda: plain(near.jaccard_join(docs)), "dedup": lambda: plain(near.deduplicate(docs)),
        "op7": lambda: sorted((r.doc_id, r.kept, round(r.llr_score, 5)) for r in rules.quality_rules(docs, docs.where("doc_id < 3")).collect()),
        "op1": lambda: plain(mixing.mix(docs, {"s0": 3.0, "s1": 1.0}, 0.5)),
    }
    want = {k: f() for k, f in runs.items()}
    for name, value in (("BROADCAST_ROWS", 0), ("HUB", 1)):
        monkeypatch.setattr(C, name, value)
    monkeypatch.setattr(rules, "KEYS", 0)
    monkeypatch.setattr(mixing, "SOURCES", 0)
    for k, f in runs.items():
        assert f() == want[k], k


def test_texts_without_candidates_are_not_shuffled(spark, monkeypatch):
    """Joins of texts with tables too large to be broadcast: only texts that are split or compared pass through a shuffle."""
    import random

    import prospectra.llm.common as C

    dice = random.Random(7)
    base = [str(dice.randrange(10**9)) for _ in range(2000)]
    texts = [" ".join([*base[: 100 * i], "other", *base[100 * i + 1 :]]) for i in range(6)]
    texts += [" ".join(str(dice.randrange(10**9)) for _ in range(2000)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    df = C.written(df, "texts")
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(near, "GROUP", 4)
    jvm = spark.sparkContext._jsc.sc()

    def shuffled():
        jvm.listenerBus().waitUntilEmpty()
        return sum(jvm.statusStore().executorList(True).apply(i).totalShuffleWrite() for i in range(jvm.statusStore().executorList(True).size()))

    before = shuffled()
    got = table(near.jaccard_join(df))
    assert [got[i].n_links for i in range(206)] == [5] * 6 + [0] * 200
    assert shuffled() - before < sum(map(len, texts)) / 4
    keys = df.where("doc_id < 6").select("doc_id")
    assert 6 <= C.sieved(df, keys, ["doc_id"]).count() <= 40 and C.with_few(df, keys, ["doc_id"]).count() == 6


def test_words_against_brute_force(docs, rows):
    """Passages of 50 words or more that occur again."""
    got = table(repeats.remove_repeats(docs, length=50, gram=20, words=True))
    found = {r[0]: list(re.finditer(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())) for r in rows}
    word = {k: [m.group() for m in ms] for k, ms in found.items()}
    seen = collections.Counter(tuple(w[i : i + 50]) for w in word.values() for i in range(len(w) - 49))
    for k, t, *_ in rows:
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for i in range(len(word[k]) - 49):
            if seen[tuple(word[k][i : i + 50])] > 1:
                mark[found[k][i].start() : found[k][i + 49].end()] = True
        assert (got[k].n_removed, got[k].kept_sha256) == (int(mark.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mark])).hexdigest())


def test_clashing_columns_are_refused(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    model = quality.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    for name, run in (("copy", lambda x: mixing.mix(x, {"s": 1.0})), ("n_bytes", repeats.remove_repeats), ("score", lambda x: quality.classify(x, model)), ("kept", lambda x: rules.quality_rules(x, x))):
        with pytest.raises(ValueError, match=name):
            run(df.withColumn(name, F.lit(1)))


def test_blocks_of_a_large_group_agree(docs, monkeypatch):
    whole = sorted(map(tuple, near.jaccard_join(docs).collect()))
    monkeypatch.setattr(near, "GROUP", 1)
    assert sorted(map(tuple, near.jaccard_join(docs).collect())) == whole


def test_base_rules_against_brute_force(docs, rows, none):
    got = table(rules.quality_rules(docs, docs.where("doc_id < 3")))
    for k, t, *_ in rows:
        w = WORD.findall(t or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often, covered = collections.Counter(windows), set()
        for i, x in enumerate(windows):
            if often[x] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[0].llr_score > got[12].llr_score and rules.quality_rules(none, docs).count() == 0 and rules.quality_rules(docs, none).count() == len(rows)


def test_buckets_grow_with_the_features(spark, docs, monkeypatch):
    many = spark.range(2800).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(599)), lambda i: F.concat(F.col("id"), F.lit("x"), i))).alias("text"))
    assert rules.fitting(docs) == rules.BUCKETS and rules.fitting(many) == rules.BUCKETS  # 1.7 million distinct words, 26 a bucket
    monkeypatch.setattr(rules, "FILL", 10)
    assert rules.fitting(many) == 4 * rules.BUCKETS
    twice = docs.unionByName(docs.limit(3))
    wide = twice.withColumn("llr", F.lit(7))
    array = rules.quality_rules(wide, docs.where("doc_id < 3")).collect()
    monkeypatch.setattr(rules, "ARRAY", 1)
    join = rules.quality_rules(wide, docs.where("doc_id < 3"))
    assert join.columns == [*wide.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr_score", "kept"]
    both = [sorted(((r.doc_id, r.text or "", r.n_words, r.kept, round(r.llr_score, 4)) for r in x)) for x in (array, join.collect())]
    assert both[0] == both[1] and len(array) == twice.count()


def test_ratio_against_brute_force(spark, docs, rows):
    """llr_score from plain counts over the same hashes."""
    import xxhash

    word = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) & ~1
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) | 1
    places = {}
    for k, t, *_ in rows:
        h = [word(w) for w in WORD.findall(t or "")]
        places[k] = [x % (2 * rules.BUCKETS) for x in (*h, *(pair(a, b) for a, b in zip(h, h[1:])))]
    raw, good = collections.Counter(x for p in places.values() for x in p), collections.Counter(x for k, p in places.items() if k < 3 for x in p)
    share = good.total() / raw.total()
    ratio = {b: np.log((good[b] + rules.SMOOTH) / (raw[b] * share + rules.SMOOTH)) for b in raw}
    for r in rules.quality_rules(docs, docs.where("doc_id < 3")).collect():
        p = places[r.doc_id]
        assert abs(r.llr_score - (sum(ratio[b] for b in p) / len(p) if p else 0)) < 1e-5
        assert r.kept == (not r.base_failed and r.llr_score >= rules.THRESHOLD)


@pytest.mark.parametrize("bits", [26, 60])
def test_very_long_text_has_exact_repeats(spark, monkeypatch, bits):
    """Windows that share high bits of their hashes can't hide each other: with 60 bits for the place, most do."""
    import random

    monkeypatch.setattr(rules, "PLACE", bits)

    dice = random.Random(11)
    w = [f"w{dice.randint(0, 400)}" for _ in range(20_000)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    df = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    assert rules.quality_rules(df, df.limit(0)).first().n_repeat_words == len(covered)


def test_quality_model_on_held_out_rows(spark):
    """Accuracy on rows that the fit hasn't seen, and scores as plain sums of table entries."""
    from bisect import bisect_right

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where(queries.remainder() != 0))
    got = quality.classify(docs, model).join(labels.where(queries.remainder() == 0).select("doc_id", "quality"), "doc_id")
    right, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right >= 0.95 * n
    for r in quality.featured(docs.limit(40)).collect():
        x = [float(v) for v in r["__x"]]
        s = model.base + sum(t[bisect_right(list(e), v)] for e, t, v in zip(model.edges, model.tables, x))
        coarse = [bisect_right(list(e), v) for e, v in zip(model.pair_edges, x)]
        s += sum(t[coarse[a] * (len(model.pair_edges[b]) + 1) + coarse[b]] for (a, b), t in zip(model.chosen, model.pair_tables))
        assert abs(model.predict(np.array([x]))[0] - 1 / (1 + np.exp(-s))) < 1e-9


def test_quality_learns(spark, docs, none):
    good = "Plain words that follow one another, as in prose. " * 5
    data = [(i, (good if i % 2 else good.upper().replace(" ", "!! ")) + " w" * (i % 7), i % 2) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    model = quality.train(df, df.select("doc_id", "quality").where("doc_id < 300"))
    got = quality.classify(df.where("doc_id >= 300"), model)
    assert got.where("predicted <> quality").count() == 0
    assert quality.classify(docs, model).where("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality.classify(docs, quality.train(docs, df.where("false"))).where("score = 0.5").count() == docs.count()


def test_language_model(docs, rows, none):
    got = table(language.score(docs, F.col("doc_id") < 10))
    tokens = {r[0]: [*re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower()), None] for r in rows}
    c = collections.Counter(w for k in tokens if k < 10 for w in tokens[k])
    n, v = sum(c.values()), len(c)
    for k, ws in tokens.items():
        assert abs(got[k].base_score - sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n) and got[k].score <= 0
    assert language.score(none, F.lit(True)).count() == 0
    assert all(r.score == 0 for r in language.score(docs, F.lit(False)).collect())


def test_score_against_a_closed_form(spark):
    """Where each pair of neighbours occurs once, every seating has one table a pair, and the score is known exactly."""
    texts = ["a b c d", "b d a c", "e f", ""]
    got = table(language.score(spark.createDataFrame([*enumerate(texts), (9, "a b e zz"), (10, None)], "doc_id int, text string"), F.col("doc_id") < 4))
    pairs = collections.Counter((u, w) for t in texts for u, w in zip(["<s>", *t.split()], [*t.split(), "</s>"]))
    few = {p: n for p, n in pairs.items() if n > 1}
    assert not few, few
    (d0, d2), (s0, s2) = language.DISCOUNT, language.STRENGTH
    tables, customers, at_root = (collections.Counter(x) for x in ([u for u, _ in pairs], [u for u, _ in pairs], [w for _, w in pairs]))
    for k, t in [*enumerate(texts), (9, "a b e zz")]:
        want = 0.0
        for u, w in zip(["<s>", *t.split()], [*t.split(), "</s>"]):
            p0 = (at_root[w] - d0 if at_root[w] else s0 + d0 * len(at_root)) / (s0 + len(pairs))
            want += np.log10((((1 - d2) if (u, w) in pairs else 0) + (s2 + d2 * tables[u]) * p0) / (s2 + customers[u]))
        assert abs(got[k].score - want) < 1e-4 and got[k].train_tokens == len(pairs)


def test_each_word_has_its_own_restaurant(spark):
    """A text of 3000 words, each once: whatever word comes before, its restaurant has one customer."""
    words = [f"w{i}" for i in range(3000)]
    got = table(language.score(spark.createDataFrame([(0, " ".join(words)), (1, "w1 w0 w2999")], "doc_id int, text string"), F.col("doc_id") == 0))
    (d0, d2), (s0, s2) = language.DISCOUNT, language.STRENGTH
    above = (s2 + d2) * (1 - d0) / (s0 + 3001) / (s2 + 1)
    seen = (1 - d2) / (s2 + 1) + above
    assert abs(got[0].score - 3001 * np.log10(seen)) < 1e-6
    assert abs(got[1].score - 3 * np.log10(above) - np.log10(seen)) < 1e-6


@pytest.mark.parametrize("codes", [18, 2])
def test_score_against_whole_restaurants(spark, monkeypatch, codes):
    """All buckets in one place, with totals added up by context; most contexts without codes in the second run."""
    import random

    monkeypatch.setattr(language, "CODES", codes)
    dice = random.Random(5)
    texts = [" ".join(f"v{int(dice.random() ** 3 * 60)}" for _ in range(30)) for _ in range(40)] + [None, "v1 new v2", "v0 " * 40]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = table(language.score(df, F.col("doc_id") % 4 != 1))
    known = {w for t in texts for w in (t or "").split()}
    h = {w: int(x) % 2**64 for w, x in spark.createDataFrame([(w,) for w in known], "w string").select("w", F.xxhash64("w")).collect()}
    rows = {k: [int(language.START), *(h[w] for w in (t or "").split()), int(language.END)] for k, t in enumerate(texts)}
    pairs, customers = collections.Counter(), collections.Counter()
    for k, x in rows.items():
        for u, w in zip(x, x[1:]):
            pairs[u, w] += k % 4 != 1
            customers[u] += k % 4 != 1
    signed = lambda u: u - 2**64 if u >= 2**63 else u
    level = collections.Counter(round(64 * np.log2(n)) for n in customers.values() if n)
    cut = min(x for x in level if sum(n for y, n in level.items() if y >= x) <= 2**codes)
    top = sorted((u for u, n in customers.items() if n and round(64 * np.log2(n)) >= cut), key=lambda u: (-customers[u], signed(u)))
    assert (len(top) < 5) == (codes == 2)
    made = []
    for b in range(8):
        asked = [(u, w) for u, w in pairs if w >> 61 == b]
        if asked:
            number = {u: i for i, u in enumerate(top + sorted({u for u, _ in asked} - set(top)))}
            words = sorted({w for _, w in asked})
            dishes = language.Dishes(np.array(words, np.uint64), np.array([words.index(w) for _, w in asked]), np.array([number[u] for u, _ in asked]), np.array([pairs[p] for p in asked]))
            made.append((dishes, [*number], np.array([customers[u] for u in number], float)))
    every, tables = np.zeros(3), [collections.Counter() for _ in range(3)]
    for dishes, names, c2 in made:
        for s, (t2, c0) in enumerate(dishes.sweeps(c2, 8.0, 11)):
            every[s] += c0.sum()
            for u, t in zip(dishes.u, t2):
                tables[s][names[u]] += t
    types, chance = sum(int((d.known > 0).sum()) for d, _, _ in made), {}
    for dishes, names, c2 in made:
        p = dishes.predict(c2, [(e, np.array([t[u] for u in names])) for e, t in zip(every, tables)], types, 8.0, 11)
        chance |= {(names[x & 0xFFFFF], int(dishes.all[x >> 20])): v for x, v in zip(dishes.asked, p)}
    assert max(pairs.values()) > language.STRETCH
    for k, x in rows.items():
        assert abs(got[k].score - sum(np.log10(chance[p]) for p in zip(x, x[1:]))) < 1e-9


def test_language_numbers_round_trip():
    x = np.array([0, 1, 254, 255, 256, 2**40])
    data = language.numbers(x) + language.numbers(x[:2])
    back, at = language.from_numbers(data, len(x), 0)
    assert np.array_equal(back, x) and np.array_equal(language.from_numbers(data, 2, at)[0], x[:2])
    h = np.array([5, 2**63 + 7, 3, 9], np.uint64)
    assert np.array_equal(language.from_hashes(language.hashes(h)), h)


def test_language_keys(spark):
    """Null and large keys come back as they are."""
    for kind, keys in (("long", [None, 2**62 + 1, 7]), ("string", [None, "x", ""])):
        got = language.score(spark.createDataFrame([(k, "a b", "clash") for k in keys], f"doc_id {kind}, text string, u string"), F.lit(True)).collect()
        assert {r.doc_id for r in got} == set(keys) and len({r.score for r in got}) == 1


def test_seating_follows_the_posterior():
    """Gibbs moves of three customers of a dish, against all their partitions."""
    rng, d, new = np.random.default_rng(4), 0.8, 0.7
    sizes = np.zeros((40_000, 3))
    for _ in range(3):
        language.sit(sizes, np.full(len(sizes), new), d, rng)
    for _ in range(12):
        for _ in range(3):
            language.get_up(sizes, rng)
            language.sit(sizes, np.full(len(sizes), new), d, rng)
    weight = np.array([new * (1 - d) * (2 - d), 3 * new**2 * (1 - d), new**3])
    share = np.bincount((sizes > 0).sum(1), minlength=4)[1:] / len(sizes)
    assert (sizes.sum(1) == 3).all() and np.abs(share - weight / weight.sum()).max() < 0.01


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = np.sort(rng.integers(1, 1 << 62, 40).astype(np.uint64))
    w, u = np.divmod(np.unique(rng.integers(0, 40 * 16, 300)), 16)
    counts = rng.integers(0, 40, len(w))
    every = np.arange(41 * 16)
    unknown = np.concatenate([words, [np.uint64(1) << np.uint64(63)]])
    d = language.Dishes(unknown, np.concatenate([w, every // 16]), np.concatenate([u, every % 16]), np.concatenate([counts, np.zeros(len(every), int)]))
    c2 = np.bincount(u, counts, 16).astype(float)
    totals = [(c0.sum(), np.bincount(d.u, t2, 16)) for t2, c0 in d.sweeps(c2, 1.0, 3)]
    known = float((d.known > 0).sum())
    p = d.predict(c2, totals, known, 1.0, 3)
    got = {int(x): v for x, v in zip(d.asked, p)}
    for context in range(16):
        mass = [got[(i << 20) | context] for i in range(41)]
        rest = [m for i, m in enumerate(mass) if d.known[i] == 0]
        assert min(mass) > 0 and abs(sum(m for i, m in enumerate(mass) if d.known[i]) + rest[0] - 1) < 1e-9


def test_blobs_round_trip():
    rng = np.random.default_rng(2)
    words = np.sort(rng.integers(1, 1 << 62, 50).astype(np.uint64))
    w, u = np.divmod(np.unique(rng.integers(0, 50 * 900, 400)), 900)
    counts = rng.choice([0, 1, 254, 255, 256, 70_000], len(w))
    for wide in (False, True):
        back = language.unpack(*language.pack(words, w, u, counts, wide), wide)
        assert all(np.array_equal(x, y) for x, y in zip(back, (words, w, u, counts)))
    x = rng.integers(0, 1 << 24, 99)
    assert np.array_equal(language.from_three(language.three(x)), x)
    assert [language.context_bits(n) for n in (0, 10**8, 10**9, 5 * 10**10, 10**15)] == [10, 10, 12, 16, 20]


def test_packing_round_trip(docs, rows, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer, got = Tokenizer.from_file(path), packing.pack(docs, path).toPandas()
    for k, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in got[got.doc_id == k].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        total = s.length.sum()
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and total <= 4096 and total & (total - 1) == 0
    assert packing.pack(none, path).count() == 0
    odd = ["a\x1cb", "don't STOP", "ünï- x²½ Ab9c", "<|endoftext|>", "áb é.", "İSTANBUL, ΣΑΣ."]
    ids = packing.WordIds(path)
    for t in odd:
        assert ids.ids(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_subset_sum_against_brute_force():
    import itertools
    import random

    dice = random.Random(4)
    for _ in range(50):
        items = [dice.randint(1, 30) for _ in range(dice.randint(1, 9))]
        room = dice.randint(1, 80)
        counts = collections.Counter(items)
        got = packing.fill(room, sorted(counts), dict(counts))
        assert not collections.Counter(got) - counts
        assert sum(got) == max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)


def test_licences(docs, none):
    got = licences.licence_scan(docs).collect()
    assert [(r.doc_id, r.licence, r.dice, r.n_matches) for r in got] == [(11, "mit", 1.0, 1)] and licences.licence_scan(none).count() == 0


def test_licences_beside_other_words(spark):
    wrapped = "// " + licences.TEMPLATES["mit-grant"].replace(" copy", "\n//   copy").replace("software and", "software\n// and")
    texts = ["Foo is a tool for bars. Released under the MIT License.", f"/*\n{wrapped}\n more words\n*/\nint main() {{}}", "Released under no license at all, the MIT way", "Released under"]
    got = licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.licence, r.dice) for r in got) == [(0, "mit", 1.0), (1, "mit-grant", 1.0)]


def test_licence_anchors():
    grams = [licences.plain_bigrams(v) for v in licences.TEMPLATES.values()]
    words = set(licences.anchors(grams, 0.8))
    for g in grams:  # bigrams without these words are too few for a match, whatever else a text has
        free = [x for x in g if not any(w in x for w in words)]
        assert 2 * len(free) / (len(free) + len(g)) < 0.8
    assert licences.anchors(grams, 0.0) is None and licences.anchors([[]], 0.8) == []


def test_word_ids():
    path = queries.tokenizer()
    ids, plain = packing.WordIds(path), Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x21, 0x300)]
    for t in ["Über straße, İstanbul don't ª1 H\u0331 \ud55c 中文 a\x1fb \x0b c", *letters, *(f"X{c}y" for c in letters)]:
        assert ids.ids(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_pages(spark):
    top, end = "<html><body><nav><a>Menu</a></nav><div class='ad box'>Buy</div>", "<footer>End</footer><script>x('</p>')</script></body>"
    html = [top + "<article><h1>A &amp;amp; B</h1><p>One\n  two<br>three<p>Four</article><div id=comments>No</div>" + end, top + "<div>Shared line</div><div>Own one</div>" + end, top + "<div>Shared line</div><div>Own two</div>" + end, None, "plain < text", "<article><p>cut off"]
    df = spark.createDataFrame([(i, None if i == 4 else f"http://h{i == 5}.org/x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = table(pages.extract(df), "page_id")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [got[i].text for i in range(6)] == ["A &amp; B\nOne two three\nFour", "Own one", "Own two", "", "plain < text", "cut off"]
    assert got[0].n_chars == len(got[0].text) and pages.extract(df.where("false")).count() == 0


def plain_extract(rows):
    """The same pairing over a plain list: nearest pages in URL order within REACH places that are no copies."""
    def split(u):
        m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", u)
        return (m[1].lower(), m[2]) if m else ("", re.match(r"[^?#]*", u)[0])
    order = sorted(rows, key=lambda r: (*split(r[1]), r[0]))
    all_lines = [pages.lines(r[2]) for r in order]
    def same(a, b):
        x, y = collections.Counter(t for t, _ in a), collections.Counter(t for t, _ in b)
        return 1000 * (x & y).total() >= pages.SAME * max(len(a), len(b))
    out = {}
    for i, r in enumerate(order):
        host, path = split(r[1])
        near = []
        for step in (-1, 1):
            for j in range(i + step, i + step * (pages.REACH + 1), step):
                if not 0 <= j < len(order) or split(order[j][1])[0] != host:
                    break
                if not same(all_lines[j], all_lines[i]):
                    near.append(j)
                    break
        share = lambda j: len(os.path.commonprefix([split(order[j][1])[1], path]))  # noqa: E731, B023
        best = max(map(share, near), default=0)
        shared = set()
        for j in near:
            if share(j) == best:
                shared |= pages.lcs([t for t, _ in all_lines[i]], [t for t, _ in all_lines[j]])[0]
        out[r[0]] = "\n".join(t for k, (t, content) in enumerate(all_lines[i]) if content or k not in shared)
    return out


def test_pages_don_t_depend_on_partitions(spark, monkeypatch):
    """Pages without article or main, against a plain list: the same for any partitioning, chunk and shuffle."""
    import random

    dice = random.Random(6)
    rows = []
    for i in range(300):
        own = [f"Line {i} {k}" for k in range(dice.randint(1, 4))] if dice.random() < 0.8 else ["A copy", "of a page", "again"]
        rows.append((i, f"http://h{i % 3 % 2}.org/{dice.choice('abc')}/{dice.randint(0, 99)}?x={i}", "".join(f"<div>{x}</div>" for x in ["Shared top", *own, f"Shared by {i % 2}"])))
    want = plain_extract(rows)
    assert sum("Shared top" not in t for t in want.values()) > 200
    for chunk, parts, shuffles in ((512, 1, 1), (40, 7, 40), (33, 300, 300)):
        monkeypatch.setattr(pages, "CHUNK", chunk)
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
        try:
            got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert {r.page_id: r.text for r in got} == want


def test_copies_are_no_neighbours(spark):
    page = lambda *own: "<div>Shared line</div>" + "".join(f"<div>{x}</div>" for x in own)
    one, two = page("Own one", "More of one"), page("Own two", "More of two")
    data = [("a.org/x/1", one), ("a.org/x/1?utm_source=y", one), ("a.org/x/1?page=2", one), ("a.org/x/2", two), ("a.org/x/2", two), ("b.org/1", one), ("b.org/1", one)]
    df = spark.createDataFrame([(i, "http://" + u, h) for i, (u, h) in enumerate(data)], "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = table(pages.extract(df), "page_id")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [got[i].text for i in range(7)] == ["Own one\nMore of one"] * 3 + ["Own two\nMore of two"] * 2 + ["Shared line\nOwn one\nMore of one"] * 2


def test_neighbours_beyond_many_copies(spark, monkeypatch):
    """A different page counts however many copies lie between, equal ones and nearly equal ones, in one chunk and in several."""
    page = lambda *own: "<div>Shared line</div>" + "".join(f"<div>{x}</div>" for x in own)
    body = [f"Line {i}" for i in range(12)]
    rows = [(0, "http://a.org/x/000", page("First one"))]
    rows += [(i, f"http://a.org/x/{i:03}", page(*body, *([f"Own {i}"] if i % 3 == 0 else []))) for i in range(1, 150)]
    rows += [(149, "http://a.org/x/149", rows[149][2])]
    rows += [(200 + i, f"http://b.org/{i:03}", page(*body)) for i in range(40)]
    for chunk in (512, 40):
        monkeypatch.setattr(pages, "CHUNK", chunk)
        monkeypatch.setattr(pages, "WIDER", 4)
        got = collections.Counter((r.page_id, r.text) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())
        want = [(0, "First one"), *((i, "\n".join([*body, *([f"Own {i}"] if i % 3 == 0 else [])])) for i in [*range(1, 150), 149]), *((200 + i, "\n".join(["Shared line", *body])) for i in range(40))]
        assert got == collections.Counter(want)


def test_lcs_against_dynamic_programme():
    import random

    dice = random.Random(2)
    for _ in range(60):
        a, b = ([dice.choice("abcd") for _ in range(dice.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j] + (x == y), best[i][j + 1], best[i + 1][j])
        ha, hb = pages.lcs(a, b)
        assert len(ha) == best[-1][-1] and [a[i] for i in sorted(ha)] == [b[j] for j in sorted(hb)]


def test_recall_with_more_lists_than_probes(spark, monkeypatch):
    dice = np.random.default_rng(9)
    base = dice.normal(size=(1200, 24))
    x = np.concatenate([base, base + dice.normal(size=base.shape) * dice.uniform(0.05, 0.5, size=(len(base), 1))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    monkeypatch.setattr(vectors, "LIST_ROWS", 20)  # 120 lists
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = table(vectors.near_dedup(df), "vec_id")
    links = np.array([got[i].n_links for i in range(len(x))])
    assert close.sum() > 500 and (links <= close.sum(1)).all() and links.sum() >= 0.9 * close.sum()


def test_vectors_against_brute_force(spark, monkeypatch):
    dice = np.random.default_rng(3)
    x = dice.normal(size=(300, 16))
    x[100:160] = x[0] + dice.normal(size=(60, 16)) * 0.15
    x[200:204] = x[5]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, [1.0] * 3)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for block in (1024, 20):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = table(vectors.near_dedup(df), "vec_id")
        assert sum(got[i].n_links == close[i].sum() for i in range(300)) >= 270
        assert sum(got[i].n_links for i in range(300)) >= 0.9 * close.sum()
        assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))
        assert got[203].component_id == 5 and got[0].kept and not got[150].kept
    assert vectors.near_dedup(df.where("false")).count() == 0
