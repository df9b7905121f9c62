"""Corpus pipeline: quality rules, near-dedup, secret scan, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next stage's input.  All but the last return the columns of
``documents``.
"""

from fieldnote.llm import mixing, near, packing, quality, secret_scan, simhash
from fieldnote.session import scratch_path


def rules(spark, docs, sf_dir):
    """Rejected documents go."""
    return quality.keep(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group stays: linked are fingerprints that differ in four bits at most, as in op2, and texts
    with a similarity of 0.8 on five words, which fingerprints miss where much was added or cut."""
    return simhash.first_of_each(docs, simhash.united(near.similar_groups(docs, words=5), simhash.groups(docs)))


def blot_secrets(spark, docs, sf_dir):
    """Secrets are blotted out; the documents stay."""
    return secret_scan.redact(docs)


def mix(spark, docs, sf_dir):
    """Every source comes near its share of the words; a document is repeated or goes as its source's target says."""
    return mixing.mix(docs)


def pack(spark, docs, sf_dir):
    """Token sequences: one row for each piece of a document and its place."""
    import public_tokenizers

    return packing.pack(spark, packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", rules),
    ("near-dedup", near_dedup),
    ("secret scan", blot_secrets),
    ("mixing", mix),
    ("packing", pack),
]
# The fingerprints and the draw of the mixture are hashes that DuckDB does not have.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
