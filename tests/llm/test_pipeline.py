"""The pipeline's stages over a small corpus, each against a plain computation, and rows of every odd kind."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from prospectra.llm import queries, rules

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels: null and empty texts, repeated rows, near copies, a passage in several texts, columns with names of results."""
    base, shared = prose(1, 300), prose(99, 80)
    close = base.split()
    close[150] = "changed"
    texts = {0: base, 1: base, 2: " ".join(close), 3: None, 4: "", 5: "too short", 6: prose(2, 120) + "\n" + shared, 7: prose(3, 200) + " " + shared + " " + prose(4, 90), 8: prose(5, 9000), 9: "same line\n" * 300, 10: prose(6, 70)}
    rows = [(k, t, "en", None if k == 6 else f"src{k % 3}", len(t or ""), "k", 1, 2) for k, t in texts.items()] + [(0, base, "en", "src0", len(base), "k", 1, 2)]
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, copy int, r int").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in (0, 6, 7, 8)] + [(9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage gives, written and read again."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_keep_the_columns(spark, folder, stages):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_copies", "repeats", "mixture", "packing"] and P.ORACLE_SQL is None
    for name in ("quality_rules", "near_copies", "repeats", "mixture"):
        assert stages[name].columns == docs.columns and stages[name].dtypes == docs.dtypes


def test_quality_rules(stages):
    got = collections.Counter(r.doc_id for r in stages["quality_rules"].collect())
    assert got == {0: 2, 1: 1, 2: 1, 6: 1, 7: 1, 8: 1, 10: 1}  # no text, few words, repeated lines go; both equal rows stay


def test_near_copies(stages):
    before = {r.doc_id: r.text for r in stages["quality_rules"].collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in before.items() if (w := WORD.findall(t))}
    kept = []
    for k in sorted(sets):
        if not any(len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) for j in sets if j < k):
            kept.append(k)
    assert sorted(r.doc_id for r in stages["near_copies"].collect()) == kept == [0, 6, 7, 8, 10]


def test_repeats(stages):
    before = {r.doc_id: r.text for r in stages["near_copies"].collect()}
    words = {k: [(m.group(), m.start(), m.end()) for m in WORD.finditer(t)] for k, t in before.items()}
    seen = collections.Counter(tuple(x for x, *_ in w[i : i + 50]) for w in words.values() for i in range(len(w) - 49))
    for r in stages["repeats"].collect():
        text, w = before[r.doc_id], words[r.doc_id]
        gone = set()
        for i in range(len(w) - 49):
            if seen[tuple(x for x, *_ in w[i : i + 50])] > 1:
                gone |= set(range(w[i][1], w[i + 49][2]))
        assert r.text == "".join(c for i, c in enumerate(text) if i not in gone) and r.n_chars == len(r.text)
        assert bool(gone) == (r.doc_id in (6, 7))


def test_mixture(stages):
    before, after = stages["repeats"].collect(), stages["mixture"].collect()
    n = collections.Counter(r.source or "" for r in before)
    total, rest = sum(n.values()), sum(v for k, v in n.items() if k not in queries.WEIGHTS)
    weight = {k: queries.WEIGHTS.get(k, queries.REST * v / max(rest, 1)) for k, v in n.items()}
    for r in before:
        source = r.source or ""
        mean = weight[source] / (sum(queries.WEIGHTS[k] for k in n if k in queries.WEIGHTS) + (queries.REST if rest else 0)) * total / n[source]
        u = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        import math

        want, c = 0, 0.0
        while (c := c + math.exp(want * math.log(mean) - mean - math.lgamma(want + 1))) <= u:
            want += 1
        assert sum(x.doc_id == r.doc_id for x in after) == want
    assert {r.text for r in after} <= {r.text for r in before}


def test_packing(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer())
    import numpy as np

    docs = collections.Counter((r.doc_id, r.text) for r in stages["mixture"].collect())
    rows = stages["packing"].toPandas()
    for (k, t), copies in docs.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id == k]
        assert own.length.sum() == copies * len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        total = s.length.sum()
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and total <= 4096 and total & (total - 1) == 0


def test_run_gives_the_last_stage(spark, folder, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    got = P.run(spark, folder)
    assert got.columns == stages["packing"].columns and sum(r[2] for r in key(got)) == sum(r[2] for r in key(stages["packing"]))


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    assert rules.THRESHOLD < 0 and F
