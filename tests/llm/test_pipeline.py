"""The stages of the pipeline against brute force, and the pipeline as a whole."""

import itertools
import random
import re

import numpy as np

import corpus_pipeline
from logloom.llm import packing
from test_operators import brute_components, brute_contamination, brute_water_fill, words

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    bench = [(i, words(30, 500 + i, 10**5)) for i in range(3)]
    rows = [(i, words(80, i, 10**5), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, r[1] + " tail", *r[2:]) for i, r in enumerate(rows[:10])]
    rows += [(200 + i, words(50, 300 + i, 10**5) + " " + bench[i][1], "en", None, 1) for i in range(3)] + [(300, "12 34", "en", "s0", 1), (301, None, None, "s0", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, DDL).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        if i < 4:
            assert docs.columns == [c.split()[0] for c in DDL.split(", ")]
            docs.write.parquet(f"{folder}/out{i}")
            docs = spark.read.parquet(f"{folder}/out{i}")
        ids = sorted(r.doc_id for r in docs.collect()) if i < 4 else []
        if name == "language_id":
            assert ids == sorted(d for d, t in before if t and any(c.isalpha() for c in t))
        elif name == "near_dedup":
            assert ids == sorted(d for d, _, c in brute_components(before, 5, 80) if d == c)
        elif name == "decontaminate":
            assert ids == sorted(d for d, t in before for n, h, _ in [brute_contamination(t, bench)] if not (h and 20 * h >= n)) and len(ids) < len(before)
        elif name == "mix":
            assert set(ids) <= {d for d, _ in before} and len(ids) > len(before) and max(map(ids.count, ids)) <= 2
            mixed = ids
            count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sizes, taken, source = {}, {}, {d: r[3] for d, *r in [(x[0], *x) for x in rows]}
            for d, t in before:
                sizes[source[d]] = sizes.get(source[d], 0) + count(t)
            for r in docs.collect():
                taken[r.source] = taken.get(r.source, 0) + count(r.text)
            weights = dict(zip([*sorted(k for k in sizes if k), *([None] if None in sizes else [])], itertools.cycle((3.0, 1.0, 2.0)), strict=False))
            # all documents have about 80 words: half of one is the nearest that can be promised
            target = brute_water_fill(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
            assert all(abs(taken[k] - target[k]) <= 41 for k in sizes), (taken, target)
            texts = sorted(r.text for r in docs.collect())
        else:
            with open(packing.VOCABULARY, "rb") as f:
                encoder = packing.Encoder(f.read())
            parts = {}
            for r in docs.collect():
                ids = np.frombuffer(r.ids, encoder.dtype)
                for d, p, (a, b) in zip(r.doc_ids, r.pieces, itertools.pairwise(r.cu_seqlens), strict=True):
                    parts.setdefault((d, p), []).append(ids[a:b].tobytes())
            assert all(p == 0 for _, p in parts) and sorted(d for (d, _), own in parts.items() for _ in own) == mixed
            assert sorted(encoder.decode(x) for own in parts.values() for x in own) == texts
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_language_stage_rejects_what_reads_like_no_language(spark):
    """Letters without words and another script go; short texts, texts with numbers and unlabelled ones stay, as do all where nothing is labelled."""
    said = {"en": "the cat sat on the mat and the dog was with them in the house ", "de": "der hund und die katze sind mit dem haus nicht auf der strasse "}
    rows = [(1000 * k + i, " ".join(random.Random(i).choices(t.split(), k=120)), lang, "s", 1) for k, (lang, t) in enumerate(said.items()) for i in range(300)]
    junk = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz ", k=500))
    good = [(5000, "the dog", None, "s", 1), (5001, "die katze 12 34 und der hund", "en", None, 1), (5002, "mat", None, "s", 1)]
    bad = [(6000, junk, "en", "s", 1), (6001, "\u043f\u0440\u0438\u0432\u0435\u0442 " * 40, None, "s", 1), (6002, None, "en", "s", 1), (6003, "12 --", "de", "s", 1)]
    docs = spark.createDataFrame(rows + good + bad, DDL)
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == sorted(r[0] for r in rows + good)
    nothing = docs.withColumn("lang", docs["lang"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang", "source", "n_chars")
    assert corpus_pipeline.language(spark, nothing, "").count() == docs.count()
