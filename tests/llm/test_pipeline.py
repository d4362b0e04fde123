"""The pipeline on a small corpus against its brute-force version."""

import hashlib
import os
import random

import numpy as np
import pytest

from .test_models import brute_shingles
from .test_small_operators import hit_words

pipeline = pytest.importorskip("corpus_pipeline")


def cleaned(docs):
    seen = {}
    for _, text, _, source, _ in docs:
        for x in (text or "").split("\n"):
            if x.strip(" "):
                seen.setdefault(x.strip(" "), set()).add(source)
    out = []
    for i, text, lang, source, n in docs:
        lines = (text or "").split("\n")
        solid = [x for x in lines if x.strip(" ")]
        cut = [x for x in solid if len(seen[x.strip(" ")]) >= (6 if len(x.strip(" ")) >= 20 else 12)]
        if 0 < len(cut) < len(solid):
            text = "\n".join(x for x in lines if x not in cut)
        out.append((i, text, lang, source, n))
    return out


def first_of_groups(docs):
    """The document with the least id of each group that similarity of 0.8 or more joins."""
    sets, root = [brute_shingles(d[1]) for d in docs], list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    first = {}
    for d, r in sorted(zip(docs, root)):
        first.setdefault(r, d)
    return list(first.values())


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from trailmark.llm.bpe_automaton import path_of
    rng = random.Random(8)
    en, de = "the of and that with for this is at on by".split(), "der die und nicht mit auf für ist ein zu".split()
    make = lambda k, n=60: " ".join(rng.choice(en if k else de) + rng.choice(["", "s", "x", "en"]) for _ in range(n))
    items = [(j, make(True, 15)) for j in range(3)]
    docs = []
    for i in range(90):
        text = make(i % 2) + "\n" + make(i % 2, 20)
        if i % 3 == 0:
            text += "\nShared footer of all sites"
        if i % 10 == 0:
            text += "\n" + items[i % 3][1]
        docs.append((i, text, "en" if i % 2 else "de", f"s{i % 15}", len(text)))
    for j in range(6):
        w = docs[2 * j][1].split(" ")
        docs.append((92 + j, " ".join(w[:20] + ["changed"] + w[21:]), docs[2 * j][2], "s3", 1))
    docs += [(100 + j, docs[5][1], "en", f"s{j % 15}", 1) for j in range(20)] + [(200, None, "en", "s1", 0), (201, "123 456", "en", "s1", 7)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(shared))
    got = {r["doc_id"]: r["ids_sha256"] for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert [x.split("-")[0] for x in set(os.listdir(shared)) - there] == ["decontamination"]

    left = cleaned([d for d in docs if d[0] < 200])
    kept = [d for d in first_of_groups(left) if not hit_words(d[1], items)[0]]
    lib = Tokenizer.from_file(path_of())
    assert got == {d[0]: hashlib.sha256(np.array(lib.encode(d[1], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for d in kept}
    assert 40 < len(got) < 91


def test_stages_return_documents(spark, tmp_path, monkeypatch):
    from trailmark.llm import language_id
    monkeypatch.setattr(language_id, "learned", lambda d: language_id.Network(["en"]))
    docs = spark.createDataFrame([(1, "the of and", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.dtypes == docs.dtypes and out.count() == frame.count(), name
