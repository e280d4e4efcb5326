"""A training corpus from ``documents``: stages that each read what the one before has kept.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``; rows with
NULL keys, NULL or empty texts and repeated rows pass as the operators say.
"""

import public_tokenizers
from pyspark.sql import Window as W, functions as F

from mailtables.llm import jaccard, mixing, packing, pii, queries, toxicity
from mailtables.llm.common import stored, table, word_count

# A corpus is built once: no document twice, and nine tenths of the tokens that are left.
PERMILLE = 900


def numbered(docs, *names):
    """``docs`` with its columns under numbers, so that none can be taken for a result, and the new names of ``names``."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), *[f"c{docs.columns.index(n)}" for n in names]


def drop_toxic(spark, docs, sf_dir):
    """Documents that the grammar, trained on ``labels``, does not reject.

    A row is judged by its text alone, so repeated rows and rows with equal keys or NULL keys are kept or rejected each by itself; NULL
    and empty texts stay. An empty table stays empty. All columns keep their names, values and places, whatever they are called.
    """
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows, key, text = numbered(docs, "doc_id", "text")
    scored = toxicity.score(rows, model, key, text)
    return scored.filter("predicted = 0").select(*rows.columns).toDF(*docs.columns)


def drop_near_copies(spark, docs, sf_dir):
    """Of each group of texts that links join, the one with the smallest key; NULL keys stay.

    Rows are told apart by key and text: of rows equal in both one stays, and a text goes only if its own
    links lead to another one. Of texts of one key that link, the one with the smallest hash stays. NULL and empty texts link
    with nothing. An empty table stays empty. Columns may have any names and keep their values.
    """
    rows, key, text = numbered(docs, "doc_id", "text")
    named = rows.filter(F.col(key).isNotNull()).withColumn("row", F.xxhash64(key, text))
    keys = stored(named.select(F.col(key).alias("doc_id"), "row"), "rows").distinct()
    linked = jaccard.link(named.select(F.col("row").alias("doc_id"), F.col(text).alias("text"))).select(
        F.col("doc_id").alias("row"), "component_id").distinct()
    first = keys.join(linked, "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    kept = stored(first.select(F.col("first.row").alias("row")), "kept")
    place = F.row_number().over(W.partitionBy("row").orderBy(F.xxhash64(*rows.columns)))
    chosen = named.join(kept, "row").withColumn("place", place).filter("place = 1")
    return chosen.select(*rows.columns).unionByName(rows.filter(F.col(key).isNull())).toDF(*docs.columns)


def redact(spark, docs, sf_dir):
    """Texts with personal data replaced by its kind; ``n_chars``, where there is one, counts the new text.

    Every row stays, repeated and empty ones too; NULL texts stay NULL, as do their counts. Other columns are left as they are.
    """
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark, docs, sf_dir):
    """The documents that fill the budgets of the sources, none of them cut.

    Documents are chosen by key: rows of one key, and those with NULL keys, go or stay together. Ties in the seeded order fall to the
    hash of the row; rows without words take part while the budget lasts. NULL languages and sources are leaves of their own. An
    empty table stays empty. Columns may have any names and keep their values.
    """
    lengths = stored(docs.select("doc_id", "lang", "source", word_count(F.col("text")).alias("n")), "lengths")
    mixed = mixing.mix(
        lengths, "doc_id", F.col("n"), F.expr(queries.DOMAINS), queries.WEIGHTS, PERMILLE, 1, queries.SEED, whole=True
    )
    chosen = mixed.select(F.col("_row.doc_id").alias("chosen"))
    rows, key = numbered(docs, "doc_id")
    return rows.join(chosen, F.col(key).eqNullSafe(F.col("chosen")), "left_semi").toDF(*docs.columns)


def pack(spark, docs, sf_dir):
    """Sequences of 2,048 ids: a row for each piece of a document.

    Every row is packed, repeated ones and NULL keys too; NULL and empty texts hold just their end. Ties in length go by the piece's
    number. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact),
    ("mixing", mix_sources),
    ("packing", pack),
]
# Learned models and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
