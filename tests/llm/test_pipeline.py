import re

import corpus_pipeline
from stayline.llm import language, mixing, ngram_join, packing, pii, quality
from stayline.llm.queries import ORACLE, QUERIES


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], sf_dir).cache())
        assert seen[-1].columns == names and seen[-1].dtypes == docs.dtypes
    good, unique, masked, mixed = seen[1:]
    rated = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in rated.where("predicted = 1").collect()}
    groups = ngram_join.similar_documents(good).collect()
    assert {r.doc_id for r in unique.collect()} == {r.component_id for r in groups}
    texts = {r.doc_id: r.text for r in unique.collect()}
    found = {r.doc_id: r["list"] for r in pii.find(unique).collect()}
    for r in masked.collect():
        assert (r.text == texts[r.doc_id]) == (not found[r.doc_id]) and r.n_chars == len(r.text)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
    taken = {r.doc_id: round(r.taken / r["size"]) for r in mixing.mix(masked).where("size > 0").collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, sf_dir).collect()
    whole = corpus_pipeline.run(spark, sf_dir).collect()

    def pieces(rows):
        return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)

    assert pieces(whole) == pieces(last) and {r.doc_id for r in last} == set(counts)


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["filter_quality", "drop_near_duplicates", "mask_personal_data", "mix_sources", "pack_documents"]
    assert language.PROFILE_SIZE and packing.SEQUENCE_TOKENS == 2048


def test_oracle(spark, sf_dir):
    from oracle_check import connect, rows_of

    con = connect(sf_dir)
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, sf_dir)
        cursor = con.execute(sql)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
