"""Texts that the given tables do not hold, where a query and its SQL could part."""

import duckdb
import pandas as pd

from loomstone.operators import chunking
from loomstone.plans import registry


def both(spark, tmp_path, query, tables):
    """Sorted rows of a query and of its SQL over some tables."""
    con = duckdb.connect()
    for name, rows in tables.items():
        rows.to_parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet')")
    ours = registry.QUERIES[query](spark, str(tmp_path))
    theirs = con.sql(f"select {', '.join(ours.columns)} from ({registry.ORACLES[query]})").fetchall()
    return sorted(tuple(r) for r in ours.collect()), sorted(theirs)


def test_paragraphs_keep_signs_that_are_their_place(spark):
    rows = spark.createDataFrame([(1, "0 first 0\n  12 second 1 \n\n210 third 2")], "id int, text string")
    (chunk,) = chunking.paragraphs(rows, key="id", text="text", cut="\n").collect()
    assert chunk.content == "0 first 0\n\n12 second 1\n\n210 third 2"


def test_paragraphs_of_odd_texts(spark, tmp_path):
    texts = ["0997 | a |", "\u00a0x\u00a0\n1 b\n\u3000", " \n \n", "", None, "\n".join(f"{i} line {i}" for i in range(400))]
    ours, theirs = both(spark, tmp_path, "ret_11_paragraph_chunks", {"documents": pd.DataFrame({"doc_id": range(len(texts)), "text": texts})})
    assert ours == theirs and len(ours) > 5


def test_questions_of_signs_only_and_with_leading_words(spark, tmp_path):
    texts = ["What is  the yield?", "wHAT\tWAS it", "???", " ?! ", "  ", "", None, "Show me", "show me ", "find \u00a0 x\u00a0", "compare\u000ba\u000bb", "\u017fhow me y", "Find find a/b-c_d.e", "\u00a0", "Tell me  about\nMine\u3000No 1", "finder"]
    rows = pd.DataFrame({"conv_id": range(len(texts)), "turn": 0, "role": "user", "text": texts})
    ours, theirs = both(spark, tmp_path, "sca_01_clean_query", {"conversations": rows})
    assert ours == theirs and (2, 0, "???") in ours and (0, 0, "the yield") in ours


def test_classes_lose_no_edge_and_do_not_grow_with_pairs(spark):
    """Edges by class and membership give every edge of all pairs; copies of a document add one row each."""
    from itertools import combinations

    from loomstone.operators import quality

    sets = {d: {v for v in range(4) if (d * 7 + v * d) % 3} for d in range(1, 13)} | {100 + i: {0, 1, 2} for i in range(200)}
    mentions = spark.createDataFrame([(d, d % 2, v) for d, vs in sets.items() for v in vs], "d long, s long, v long")
    rows = quality.relate_classes(mentions, document="d", scope="s", value="v", kind="K", confidence=1.0).collect()
    leader = {r.target_document_id: r.source_document_id for r in rows if r.relationship_type == "MEMBER"}
    own = {r.target_document_id: r.n_shared for r in rows if r.relationship_type == "MEMBER"}
    edges = {(r.source_document_id, r.target_document_id): r.n_shared for r in rows if r.relationship_type == "K"}
    for a, b in combinations(sorted(d for d, vs in sets.items() if vs), 2):
        if a % 2 == b % 2:
            x, y = sorted((leader[a], leader[b]))
            assert (own[a] if x == y else edges.get((x, y), 0)) == len(sets[a] & sets[b])
    assert len(rows) < 300


def test_notes_and_pairs_are_dealt_over_tasks(spark):
    from loomstone.plans import governance
    from loomstone.plans.catalog import Tables

    assert governance._notes(Tables(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_every_pair_of_an_organization_is_a_row(spark, tmp_path):
    """Suppliers of equal and of other years, in two nations, in none, given twice, without a date: no pair is left to a class."""
    from itertools import combinations

    years = {d: {1995, 1996} for d in range(1, 9)} | {9: {1996}, 10: {1997}, 11: {1995, 1997}, 12: {None}, 13: {1995}, 14: {1995, None}}
    nations = [(d, 1 + (d in (7, 8))) for d in range(1, 13)] + [(8, 1), (3, 1), (13, None), (14, 1), (14, None)]
    items = [(d, y and pd.Timestamp(y, month, 1)) for d, ys in years.items() for y in ys for month in (5, 12)] + [(None, pd.Timestamp(1995, 5, 1))]
    tables = {
        "supplier": pd.DataFrame({"s_suppkey": [d for d, _ in nations], "s_nationkey": pd.array([n for _, n in nations], dtype="Int64")}),
        "lineitem": pd.DataFrame({"l_suppkey": pd.array([d for d, _ in items], dtype="Int64"), "l_shipdate": pd.Series([at for _, at in items], dtype="datetime64[us]")}),
    }
    ours, theirs = both(spark, tmp_path, "jon_11_pairs_in_organization", tables)
    have = {d: {(n, y) for at, n in nations if at == d and n for y in ys if y} for d, ys in years.items()}
    want = [(a, b, len(have[a] & have[b]), "SAME_PERIOD", 0.95) for a, b in combinations(sorted(have), 2) if have[a] & have[b]]
    assert ours == theirs == want and (1, 2, 2, "SAME_PERIOD", 0.95) in ours and len(ours) > 40


def test_every_pair_is_made_of_parts_of_classes(spark):
    from itertools import combinations

    from loomstone.operators import quality

    sets = {d: {("s", v) for v in range(3) if d % 5 != v} for d in range(60)} | {d: {("s", 0), ("t", 0), ("t", 1)} for d in range(60, 80)} | {80: {("t", 1)}, 81: {("u", 0)}}
    mentions = spark.createDataFrame([(d, s, v) for d, vs in sets.items() for s, v in vs] * 2, "d long, s string, v long")
    rows = quality.relate_alike(mentions, document="d", scope="s", value="v", kind="MEMBER", confidence=1.0, most=4)
    assert sorted(tuple(r)[:3] for r in rows.collect()) == [(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]]
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
