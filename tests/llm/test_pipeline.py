"""The pipeline's stages on a small folder of tables with planted cases."""

import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(30_000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        t = text(rng.randrange(30, 90)).split()
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["scumbag", "idiot", "moron"]))
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    base = text(120)
    passage, item = text(60), text(25)
    rows += [(1000, base), (1001, base), (1002, base.replace(" w1", " x1", 1) + " end")]
    rows += [(1100, f"{text(50)} {passage} {text(50)}"), (1101, f"{text(40)} {passage} {text(60)}"), (1200, f"{text(40)} {item} {text(40)}"), (1300, "total scumbag idiot moron idiot scumbag"), (1400, None), (1401, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        at.write.parquet(path)
        at = spark.read.parquet(path)
        kept[name] = {r.doc_id: r for r in at.collect()}
    clean = {i for i in range(200) if i % 5}
    assert 1300 not in kept["toxicity"] and clean <= set(kept["toxicity"]) and len(set(kept["toxicity"]) & {i for i in range(200) if i % 5 == 0}) < 4
    near = set(kept["near duplicates"])
    assert 1000 in near and not {1001, 1002} & near and clean | {1100, 1101, 1200, 1400, 1401} <= near
    cut = kept["repeated passages"]
    assert passage in cut[1100].text and passage not in cut[1101].text and cut[1101].n_chars == len(cut[1101].text) < len(dict(rows)[1101]) - 200
    assert set(kept["decontamination"]) == set(cut) - {1200}
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    words = {i: len((r.text or "").split()) for i, r in kept["decontamination"].items()}
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == words
