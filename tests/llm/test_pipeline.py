"""Each stage of the pipeline on all that its predecessor kept, against brute force."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from seqloom.llm import mixing
from seqloom.llm.common import prepare
from seqloom.llm.subwords import Subwords
from tests.llm.test_operators import later_lines, made_texts, shingles


def test_stages(spark, tmp_path):
    prepare(spark)
    texts = made_texts(120, 21)
    texts += [texts[3], texts[4] + " more", texts[5].split("\n")[0] + "\nits own line of quite some words here"]
    toxic = [f"scum idiot {t} idiot scum moron" for t in made_texts(30, 22)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts + toxic)] + [(900, None, None, None, None), (901, "", "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i >= len(texts))) for i in range(len(texts) + len(toxic))]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append(docs.collect())
    clean, lines, near, mixed, packed = kept
    left = {r["doc_id"] for r in clean}
    assert {900, 901} <= left and len(left & set(range(len(texts)))) >= len(texts) - 2 and len(left & set(range(len(texts), 150))) <= 2
    removed = later_lines(sorted((r["doc_id"], r["text"]) for r in clean))
    for before, after in zip(sorted(clean, key=lambda r: r["doc_id"]), sorted(lines, key=lambda r: r["doc_id"]), strict=True):
        gone = removed.get(before["doc_id"], [])
        want = before["text"] and "\n".join(x for n, x in enumerate(before["text"].split("\n")) if n not in gone)
        assert after["text"] == want and (not gone or after["n_chars"] == len(want))
    sets = {r["doc_id"]: shingles(r["text"]) for r in lines}
    ids = [r["doc_id"] for r in near]
    assert len(ids) == len(set(ids)) and set(ids) <= set(sets)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i in set(sets) - set(ids):
        assert any(j < i and alike(sets[i], sets[j]) >= 0.7 for j in sets)
    assert all(alike(sets[i], sets[j]) < 0.88 for i in ids for j in ids if i < j)
    sizes = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in near}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "out2")), keep=["doc_id"]).collect()}
    times = Counter(r["doc_id"] for r in mixed)
    assert times == Counter({i: int(taken[i] / n + 0.5) for i, n in sizes.items() if n and int(taken[i] / n + 0.5)})
    tokens, sequences = defaultdict(int), defaultdict(int)
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]] += r["length"]
    text_of = {r["doc_id"]: r["text"] for r in mixed}
    assert dict(tokens) == {i: n * (len(Subwords().encode(text_of[i])) + 1) for i, n in times.items()}
    assert max(sequences.values()) <= 2048 and len(sequences) <= np.ceil(sum(sequences.values()) / 2048) + 1


def test_awkward_tables_pass_every_stage(spark, tmp_path):
    """Nulls in any column, shared ids, repeated rows, empty and long texts, and columns whose names the stages use themselves."""
    prepare(spark)
    texts = made_texts(30, 5)
    rows = [(i, t, "en", "s0", len(t), "keep", 3, 0.5, 7, "m") for i, t in enumerate(texts)]
    rows += [(2, "a text of its own that shares the number two with another row", None, None, None, "keep", 3, 0.5, 7, "m")]
    rows += [(None, "no number at all but quite some words in it", "en", "s1", 5, None, None, None, None, None), (50, None, "en", "s1", 0, "keep", 3, 0.5, 7, "m"), (51, "", None, "s1", 0, "keep", 3, 0.5, 7, "m")]
    rows += [rows[4], (52, "word " * 30_000, "en", "s1", 150_000, "keep", 3, 0.5, 7, "m")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, size string, line int, toxicity double, times int, doc string"
    spark.createDataFrame([(k, k % 5 == 0) for k in range(40)], "doc_id long, toxic boolean").selectExpr("doc_id", "int(toxic) AS toxic").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    for name, given in (("some", rows), ("none", [])):
        spark.createDataFrame(given, schema).write.parquet(str(tmp_path / f"{name}-0"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, spark.read.parquet(str(tmp_path / f"{name}-{k}")), str(tmp_path))
            out.write.parquet(str(tmp_path / f"{name}-{k + 1}"))
            got = spark.read.parquet(str(tmp_path / f"{name}-{k + 1}"))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert got.dtypes == spark.read.parquet(str(tmp_path / f"{name}-0")).dtypes
                assert {(r["size"], r["line"], r["toxicity"], r["times"], r["doc"]) for r in got.collect()} <= {("keep", 3, 0.5, 7, "m"), (None,) * 5}
            if name == "some" and k < 3:
                found = [(r["doc_id"], r["text"]) for r in got.collect()]
                assert (2, rows[30][1]) in found and (2, texts[2]) in found and (None, rows[31][1]) in found
                assert len(found) == len(rows) - (2 if k == 2 else 0)
