"""The stages one by one, each held against what it must do on its own input."""

from collections import Counter

import corpus_pipeline
from fathomline.llm import bpe, decontam, quality, secrets, simhash


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "bpe"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, bench = spark.read.parquet(f"{data}/labels.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    (_, good), (_, apart), (_, fresh), (_, masked), (_, last) = corpus_pipeline.STAGES

    one = good(spark, docs, data).cache()
    assert one.columns == docs.columns and ids(one) == ids(quality.report(docs, labels).where("predicted = 1"))
    two = apart(spark, one, data).cache()
    assert two.columns == docs.columns and ids(two) <= ids(one)
    rows = {r.doc_id: r.text for r in one.collect()}
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5)) for i, t in rows.items()}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    kept = set(ids(two))
    for i in rows:
        like = [j for j in rows if j != i and near(sets[i], sets[j])]
        if not like:
            assert i in kept
        elif i in kept:
            assert not any(j in kept for j in like)
    three = fresh(spark, two, data).cache()
    assert ids(three) == ids(decontam.report(two, bench).where("not contaminated"))
    four = masked(spark, three, data).cache()
    assert four.columns == docs.columns and ids(four) == ids(three) and all(r.n_chars == len(r.text) for r in four.collect())
    assert secrets.report(four).where("n_assign + n_access + n_hex > 0").count() == 0
    five = {r.doc_id: r for r in last(spark, four, data).collect()}
    want = {r.doc_id: r for r in bpe.report(four).collect()}
    assert {i: (r.n_tokens, r.decoded_sha256) for i, r in five.items()} == {i: (r.n_tokens, r.decoded_sha256) for i, r in want.items()}
    assert all(len(r.ids) == r.n_tokens for r in five.values())
    assert ids(corpus_pipeline.run(spark, data)) == Counter(five.keys())


def staged(spark, docs, folder):
    """What each stage keeps of ``docs``, written and read again."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_odd_documents(spark, data, odd, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{table}.parquet").where("false").write.parquet(str(tmp_path / f"{table}.parquet"))
    clash = odd
    for name in ("key", "node", "uid", "first", "class", "component", "again", "score", "fp", "block", "secret_doc", "ids", "a b.c"):
        clash = clash.withColumn(name, clash["hits"])
    one, two, three, four, five = staged(spark, clash, tmp_path)
    assert all(d.columns == clash.columns for d in (one, two, three, four))
    assert ids(one) == ids(clash)  # no labels: a half, which is enough
    assert ids(two) == Counter([1, 2, None, 4, 4, 6]) and ids(three) == ids(two) == ids(four)
    kept = {(r.doc_id, r.hits): r for r in four.collect()}
    assert all(r.n_chars == len(r.text) for r in kept.values() if r.text is not None)
    assert "hunter2" not in kept[1, 0].text and kept[4, 4].text.startswith("w0 w1 w2")
    assert five.columns == [c for c in clash.columns if c not in ("text", "ids")] + ["n_tokens", "ids", "decoded_sha256"]
    assert five.count() == 6 and all(len(r.ids) == r.n_tokens for r in five.collect())


def test_empty_documents_and_no_n_chars(spark, data, odd, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    few = odd.drop("n_chars", "hits", "row")
    for i, docs in enumerate((few.where("false"), few.where("text is null"), few)):
        (tmp_path / str(i)).mkdir()
        for table in ("labels", "benchmark"):
            (tmp_path / str(i) / f"{table}.parquet").symlink_to(tmp_path / f"{table}.parquet")
        *_, four, five = staged(spark, docs, tmp_path / str(i))
        assert four.columns == few.columns and five.count() == four.count() <= docs.count()
