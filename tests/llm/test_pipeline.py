"""Each stage of the pipeline against brute force on the smallest tables."""

import zlib

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from stratavox.llm import packing, pii
from tests.llm.test_operators import TOKENIZER, base_by_force, contaminated_by_force, linked_by_force

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append(docs.toPandas())
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = [dict(zip(o.doc_id, o.text)) for o in out[:4]]
    first = dict(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))

    for i, t in first.items():
        n = base_by_force(t)
        if n[0] < 20 or 100 * n[4] > 30 * n[0]:
            assert i not in texts[0]
    links = linked_by_force(list(texts[0].items()), 5, 80)
    assert set(texts[1]) == {i for i, (_, root) in links.items() if i == root}
    items = list(zip(*pq.read_table(f"{SF}/benchmark.parquet", columns=["item_id", "text"]).to_pydict().values()))
    assert set(texts[2]) == {x[0] for x in contaminated_by_force(list(texts[1].items()), items) if not x[5]}
    for i, t in texts[2].items():
        base = pii.base_spans(t)
        assert texts[3][i] == pii.masked(t, base + pii.added_spans(pii.train(), t, base))
    assert (out[3].n_chars == out[3].text.str.len()).all()

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    pieces = {(r.doc_id, r.start): r for r in out[4].itertuples()}
    for i, text in texts[3].items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        own = [r for (d, _), r in pieces.items() if d == i]
        assert sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    assert out[4].groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_stages_on_empty_and_odd_rows(spark, tmp_path):
    """Nulls, empties, repeats and extra columns pass every stage without a crash."""
    long = "the quick brown fox jumps over a lazy dog and runs far away from here to there " * 3
    rows = [(None, "x " + long, "en"), (1, None, "en"), (2, "", "en"), (3, long, None), (3, long, None), (4, long + "z", "en")]
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string, kept string")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
        assert n or docs.count() == 0
