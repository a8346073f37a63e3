import random

import corpus_pipeline
from kinsieve.llm import pii
from llm.helpers import docs


def test_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(12)
    w = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    passage = w(60)
    a, b = w(120), w(100)
    near = list(a)
    near[50] = "changed"
    texts = [" ".join(a), " ".join(near), " ".join(a), "too short", " ".join(["again"] * 60), " ".join([*w(40), *passage]), " ".join([*passage, *w(40)]), " ".join(b) + " mail x.y@z.org now", None]
    texts += [" ".join(w(rng.randint(30, 80))) for _ in range(20)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == now.columns
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now.collect())
    ids = [{r.doc_id for r in rows} for rows in seen]
    assert ids[0] == set(range(len(texts))) - {3, 4, 8}
    assert ids[1] == ids[0] - {1, 2}
    assert ids[2] == ids[1] and ids[3] == ids[1]
    after = {r.doc_id: r.text for r in seen[2]}
    assert after[5] == texts[5] and after[6] == " ".join(texts[6].split(" ")[60:])
    assert {r.doc_id: r.text for r in seen[3]} == {i: pii.masked(t) for i, t in after.items()}
    whole = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in seen[4]}
    assert {r[0] for r in whole} == ids[3]
    run = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == whole
