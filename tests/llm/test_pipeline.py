import random

import corpus_pipeline as pipeline
import public_tokenizers
import tiktoken

from factloom.llm import bpe


def tables(spark, folder):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(30)) for k in range(5)]
    rows, labels = [], []
    for k in range(240):
        good = k % 6 != 0
        body = text(rng.randint(60, 120))
        rows.append([k, body if good else body.replace(" ", "### "), "en", "s0", 0])
        labels.append((k, int(good)))
    clean = [r for r in rows if r[0] % 6]
    rows.append([900, clean[0][1] + " more words", "en", "s1", 0])  # a near copy
    rows.append([901, text(40) + " " + items[2][1] + " " + text(40), "en", "s1", 0])
    rows.append([902, text(80) + ' password = "hunter2hunter2" ' + text(10), "en", "s1", 0])
    rows += [[903, None, None, None, None], [None, text(70), None, None, None]]
    rows += [list(clean[1])]  # a repeated row
    for r in rows:
        r[4] = len(r[1]) if r[1] is not None else None
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = tables(spark, str(tmp_path))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/out-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    junk = {r[0] for r in rows if r[0] is not None and r[0] < 900 and r[0] % 6 == 0}
    assert not junk & set(seen["quality"])
    assert {r[0] for r in rows if r[0] is not None and r[0] % 6 and r[0] < 903} <= set(seen["quality"])
    assert set(seen["quality"]) - set(seen["near_duplicates"]) == {900}
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {901}
    assert "hunter2" not in seen["secrets"][902].text and seen["secrets"][902].n_chars == len(seen["secrets"][902].text)
    own = bpe.encoder_for(open(pipeline.VOCABULARY, "rb").read(), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for k, r in seen["secrets"].items():
        assert seen["encoding"][k].ids == other.encode_ordinary(r.text or "")
    total = pipeline.run(spark, str(tmp_path))
    assert total.count() == len({r[0] for r in rows}) - len(junk) - 2 - (903 not in seen["quality"])
