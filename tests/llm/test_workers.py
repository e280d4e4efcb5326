"""What Python workers keep between the tasks of different stages."""

import public_tokenizers

from mailtables.llm import common, packing, tokens


def test_encoders_are_dropped_when_other_stages_begin(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string").coalesce(1)

    def left(batch):
        yield {"n": [len(tokens._encoders)] * len(batch["doc_id"])}

    assert packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 1
    assert [r.n for r in common.arrow_map(docs.select("doc_id"), left, "n long").collect()] == [0]
    tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    tokens.release()
    assert not tokens._encoders
