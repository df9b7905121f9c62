"""The pipeline's stages: columns, order and effects."""

import corpus_pipeline as P
import __spark_entry__ as entry
from fieldnote.llm import queries


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in P.STAGES] == ["quality rules", "near-dedup", "secret scan", "mixing", "packing"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "near-dedup":
            assert docs.select("doc_id").distinct().count() == docs.count()
        if name == "secret scan":
            assert docs.filter("text rlike 'token = \"[0-9a-f]{24}'").count() == 0
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_the_run_equals_its_stages(spark, sf):
    assert P.run(spark, sf).count() > 0
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_near_dedup_links_by_fingerprints_and_by_similarity(spark, sf):
    """Documents that op2 puts into one component leave one, and so do near copies that only their sets tell."""
    import random

    from fieldnote.llm import near, simhash

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(400)]
    other = [rnd.choice(words) for _ in range(400)]
    pairs = [(1, " ".join(base)), (2, " ".join(base + [rnd.choice(words) for _ in range(70)])), (3, " ".join(other)), (4, "a b c d e"), (5, "A  B c d\te")]
    made = []
    for k in range(300):  # short texts of which op2 links some that the sets keep apart
        text = [rnd.choice(words) for _ in range(60)]
        made += [(100 + 2 * k, " ".join(text)), (101 + 2 * k, " ".join(text[:30] + [rnd.choice(words)] + text[31:45] + [rnd.choice(words)] + text[46:]))]
    docs = spark.createDataFrame(pairs + made, "doc_id long, text string").cache()
    by_print = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    by_set = {r["doc_id"]: r["component"] for r in near.similar_groups(docs, words=5).collect()}
    apart = [k for k in range(300) if by_print[100 + 2 * k] == by_print[101 + 2 * k] and by_set[100 + 2 * k] != by_set[101 + 2 * k]]
    assert apart  # links of the fingerprints alone
    kept = {r["doc_id"] for r in P.near_dedup(spark, docs, sf).collect()}
    assert kept & {1, 2, 3, 4, 5} == {1, 3, 4}
    assert all(101 + 2 * k not in kept for k in apart)
    # Exactly the least of each component of both kinds of links.
    parent = {i: i for i in by_set}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for of in (by_print, by_set):
        first = {}
        for i in sorted(of):
            a, b = top(first.setdefault(of[i], i)), top(i)
            parent[max(a, b)] = min(a, b)
    assert kept == {i for i in parent if top(i) == i}
