"""The stages of the corpus pipeline."""

import corpus_pipeline
from quiltframe.llm import batches, jaccard_join


def test_texts_with_letters_stay_if_no_language_is_known(spark):
    rows = [(1, "a text of words", None), (2, "12 !!", None), (3, None, None), (4, "слово", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    left = corpus_pipeline.known_language(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 4] and left.columns == docs.columns


def test_run_on_odd_rows(spark, tmp_path):
    words = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnopqr"]
    text = [" ".join(words[i:i + 20]) for i in range(0, 40, 2)]
    rows = [(i, t, "en", f"s{i % 2}", i) for i, t in enumerate(" ".join(reversed(x.split())) + f" end{i}" for i, x in enumerate(text))]
    rows += [(3, "quite another text of eight words under three", "en", "s1", 1), rows[4], rows[4],
             (90, None, None, None, None), (91, "", "en", "s0", 1), (None, "a text that has no id at all", None, None, 2)]
    schema = "doc_id bigint, text string, lang string, source string, size int"
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for name, docs in (("odd", spark.createDataFrame(rows, schema)), ("empty", spark.createDataFrame([], schema))):
        docs.withColumn("kept", docs.size).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        benchmark.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert found.columns == ["doc_id", "text", "lang", "source", "size", "kept", "mix_size", "source_size", "target", "taken"]
    got = found.collect()
    assert all(r.taken > 0 and r.taken <= 2 * r.mix_size and r.mix_size == len(r.text.split()) for r in got)
    assert len({(r.doc_id, r.text) for r in got}) == len(got) and {r.doc_id for r in got} <= {r[0] for r in rows}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_python_workers_take_bounded_batches(spark, monkeypatch, tmp_path):
    original, seen = jaccard_join._scan, str(tmp_path / "sizes")

    def recorded(width):
        scan = original(width)

        def note(rows):
            for batch in rows:
                with open(seen, "a") as out:
                    out.write(f"{batch.num_rows} {batch.nbytes}\n")
                yield batch

        return lambda rows: scan(note(rows))

    monkeypatch.setattr(jaccard_join, "_scan", recorded)
    monkeypatch.setattr(batches, "BATCH", "1m")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 300) AS text")
        assert corpus_pipeline.without_near_copies(spark, docs, "").count() == 2000
        sizes = [tuple(map(int, x.split())) for x in open(seen)]
        assert sum(n for n, _ in sizes) == 2000 and max(b for _, b in sizes) < 2 << 20
    finally:
        spark.conf.set(key, before)
