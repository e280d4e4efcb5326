"""The registered queries of this folder: ``name -> function(spark, sf_dir) -> DataFrame``."""

import public_tokenizers
from pyspark.sql import functions as F

from . import idfile, jaccard, mixing, negatives, packing, pii, quality, ranked, sharding, suffixes, topk, toxicity, warc
from .common import stored, table, word_count

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


SHARDS = {i: 2 if i % 4 == 0 else 1 for i in range(12)}


@query
def op1_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS).withColumn("shard", F.col("shard").cast("long"))


@query
def op2_jaccard_join(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"))


@query
def op3_exact_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"))


@query
def op4_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).drop("source")


@query
def op5_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return idfile.read_ids(idfile.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), kind="byte"))


@query
def op6_warc(spark, sf_dir):
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.resolve(warc.reassemble(warc.read_records(archives))).select(
        warc.page_key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_key("refers_to").alias("refers_to"), "error",
    )


# The domain of a source, and how many parts of the mixture each value gets.
DOMAINS = "get(array('web', 'books', 'code', 'forums'), try_cast(substring(source, 4) as int) % 4)"
WEIGHTS = {
    "domain": {"web": 2, "books": 4, "code": 3, "forums": 1},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 1, "src1": 3, "src2": 2},
}
PERMILLE, EPOCHS, SEED = 600, 2, 7


@query
def op7_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", word_count(F.col("text")).alias("n"))
    mixed = mixing.mix(stored(docs, "lengths"), "doc_id", F.col("n"), F.expr(DOMAINS), WEIGHTS, PERMILLE, EPOCHS, SEED)
    return mixed.select("_row.doc_id", "epoch", "domain", "_row.lang", "_row.source", "taken")


@query
def op8_personal_data(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@query
def op10_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_negatives(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"))


@query
def op13_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))
