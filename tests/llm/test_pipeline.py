"""The pipeline against a brute-force version of its stages."""

import re
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from test_operators_llm import near, passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_keep_columns(spark, documents, tmp_path):
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, documents, str(tmp_path)).columns == documents.columns


def test_run(spark, texts, documents, tmp_path):
    rows = documents.dropDuplicates(["doc_id"])
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Without labels every text scores 0.5, so all go on.
    unique = list({d: (d, t) for d, t in texts}.values())
    stay = [(d, t) for (d, t), (_, _, c) in zip(unique, near(unique, 5)) if d is None or d == c]
    gone = {d: n for d, _, n, _ in passages(stay, 50)}
    assert {r["doc_id"] for r in got} <= {d for d, _ in stay}
    one = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    size = {d: len(WORD.findall(t or "")) for d, t in stay}
    text = dict(stay)
    assert all(r["round_trip"] for r in got)
    assert max(Counter(r["doc_id"] for r in got).values()) <= 3
    for r in got:
        if not gone[r["doc_id"]]:
            assert r["n_pieces"] == len(one.encode(text[r["doc_id"]] or ""))
            assert r["n_chars"] == len(text[r["doc_id"]] or "")
    taken, whole = sum(size[r["doc_id"]] - gone[r["doc_id"]] for r in got), sum(size.values()) - sum(gone.values())
    assert abs(taken - whole) < 0.5 * whole
