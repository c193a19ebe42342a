import random

from tokenizers import Tokenizer

import corpus_pipeline
from sourcesieve.llm import secrets


def corpus(folder, spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(240):
        words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ou"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(30, 120))]
        bad = i % 6 == 0
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        if i % 10 == 3:
            text += " password: hunter2222"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(1000 + i, rows[i][1], "en", "src0", rows[i][4]) for i in range(1, 240, 5)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "src1", 0), (7, rows[7][1], "en", "src1", rows[7][4]), (None, "a text without an id " * 9, "en", "src1", 189)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_and_run(spark, tmp_path, vocabulary):
    rows = corpus(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
        docs = corpus_pipeline.written(out, name)
        seen[name] = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "neardup", "secrets", "mix", "bpe"]
    bad = {r[0] for r in rows if r[1] and "!!" in r[1]}
    kept = [r.doc_id for r in seen["quality"]]
    assert not bad & set(kept) and len(kept) == len(rows) - len([r for r in rows if r[0] in bad])
    unique = [r.doc_id for r in seen["neardup"]]
    assert len(unique) == len({r.text or "" for r in seen["quality"]}) and all(i is None or i < 1000 or i == 2000 for i in unique)
    assert sorted(str(r.doc_id) for r in seen["secrets"]) == sorted(map(str, unique))
    for r in seen["secrets"]:
        assert r.text is None or ("hunter2222" not in r.text and len(r.text) == r.n_chars)
    assert {r.doc_id for r in seen["mix"]} <= set(unique)
    library = Tokenizer.from_file(vocabulary)
    texts = {r.doc_id: r.text for r in seen["mix"]}
    assert sorted((str(r.doc_id), r.n_tokens) for r in seen["bpe"]) == sorted((str(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in seen["mix"])
    assert all(r.token_ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids for r in seen["bpe"])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, seen["bpe"]))
    assert secrets.KINDS[0] == "assign"


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
