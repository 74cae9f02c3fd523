"""The pipeline's stages one after the other, against plain versions of each on a small corpus."""

import random
import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import copies, documents, prose, slow_fingerprint


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    texts = [prose(rng, 90) for _ in range(80)]
    texts += [texts[3], texts[4] + " ", "short", None, " ".join(w + "###" for w in texts[5].split()), "token = " + "0a" * 20 + " " + texts[6]]
    rows = [(i, t, f"src{i % 2}") for i, t in enumerate(texts)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(84, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
    kept = {r.doc_id for r in seen[0].collect()}
    assert kept == set(range(82)) | {85}
    fps = {i: slow_fingerprint(t) for i, t, _ in rows if i in kept}
    first = {i for i in kept if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 3 for j in kept)}
    assert {r.doc_id for r in seen[1].collect()} == first and 80 not in first and 81 not in first
    clean = {r.doc_id: r for r in seen[2].collect()}
    assert set(clean) == first and clean[85].text == "[SECRET] " + texts[6] and clean[85].n_chars == len(clean[85].text)
    assert all(r.text == texts[i] for i, r in clean.items() if i != 85)
    size = Counter()
    for r in clean.values():
        size[r.source] += r.n_chars
    weights = {s: corpus_pipeline.queries.SOURCE_WEIGHTS[s] for s in size}
    rate = {s: weights[s] / sum(weights.values()) * sum(size.values()) / size[s] for s in size}
    assert Counter(r.doc_id for r in seen[3].collect()) == Counter({i: n for i, r in clean.items() if (n := copies(7, i, rate[r.source]))})
    assert Counter(r.doc_id for r in seen[4].collect()) == Counter(r.doc_id for r in seen[3].collect())
    assert all(re.fullmatch("[0-9a-f]{64}", r.ids_sha256) for r in seen[4].collect())
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, seen[4].collect()))
