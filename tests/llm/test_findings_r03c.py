"""What the pipeline's packing stage was stopped for: memory of an executor."""

import random
import zlib

import corpus_pipeline
from tidewright.llm import common, packing, tokens


def test_batches_of_texts_are_small(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    for name in names:
        spark.conf.unset(name)
    common.arrow_rows(spark)
    assert [int(spark.conf.get(n)) for n in names] == [common.ARROW_ROWS] * 2


def test_codecs_that_remember_less_give_equal_ids():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdeÉß1,.", k=rng.randint(1, 9))) for _ in range(200)) for _ in range(60)]
    small, usual = (tokens.codec("word_bpe_49k.json", ids=True, remembered=n) for n in (500, tokens.MEMORY_PIECES))
    for text in [*texts, *texts, None, ""]:
        assert small.encode(text) == usual.encode(text)
        assert len(small) <= 500 and len(small.old) <= 500
    assert len(usual) > 1000


def test_packing_stage_bounds_its_memory(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} and another, {i}" if i % 9 else None) for i in range(300)], "doc_id long, text string")
    asked = []
    pieces = packing.token_pieces
    monkeypatch.setattr(packing, "token_pieces", lambda *a: asked.append(a[3]) or pieces(*a))
    rows = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    assert asked == [corpus_pipeline.REMEMBERED] and corpus_pipeline.REMEMBERED < tokens.MEMORY_PIECES
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.pack(docs).collect())) and len(rows) == 300
    encode = tokens.codec("word_bpe_49k.json", ids=True).encode
    assert all(r["ids_crc32"] == zlib.crc32(encode(f"word{r['doc_id'] % 7} and another, {r['doc_id']}" if r["doc_id"] % 9 else None) + b"\2\0\0\0") for r in rows)
