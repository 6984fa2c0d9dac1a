"""Queries through indexes built from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomstone.operators.inverted import Index
from loomstone.plans.catalog import Tables, query
from loomstone.plans.retrieval import LEX, SEARCH
from loomstone.session import shared_folder

_BUILT: dict[tuple[str, str], Index] = {}


def new_index(t: Tables) -> Index:
    return Index(t.spark, f"{shared_folder(t.spark).rstrip('/')}/index-{uuid.uuid4().hex[:12]}")


def documents_index(t: Tables) -> Index:
    """The index over all documents, built once for an application and a folder of tables."""
    at = (t.spark.sparkContext.applicationId, t.documents.inputFiles()[0])
    if at not in _BUILT:
        index = new_index(t)
        index.append(t.documents, key="doc_id", columns=["text"])
        _BUILT[at] = index
    return _BUILT[at]


@query("ret_01_indexed", f"WITH {LEX} SELECT * FROM lex")
def ret_01(t: Tables):
    return documents_index(t).lexical(SEARCH, key="doc_id", columns={"text": 1})


WORDS = r"regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_\-]+')"


@query("ret_02_indexed", f"""SELECT doc_id FROM documents WHERE list_contains({WORDS}, 'the') AND contains(lower(text), 'of the') AND NOT list_contains({WORDS}, 'from')
UNION ALL SELECT -1 - doc_id FROM documents WHERE contains(lower(text), 'he on the t') AND (list_contains({WORDS}, 'thing') OR list_contains({WORDS}, 'onre') OR list_contains({WORDS}, 'with'))""")
def ret_02(t: Tables):
    """A phrase, a word and an unwanted one; and (negative) a phrase that begins and ends within words, and one of three words."""
    index = documents_index(t)
    long = index.matches('"he on the t" thing OR onre OR with', key="doc_id", column="text").select((-1 - F.col("doc_id")).alias("doc_id"))
    return index.matches('the "of the" -from', key="doc_id", column="text").unionByName(long)


#: Documents divisible by 3 come later, those divisible by 5 change to other words, those divisible by 7 go.
CHANGED = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Thing-onre ' || doc_id || ' thing' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"


def _changed(t: Tables) -> Index:
    index, docs = new_index(t), t.documents
    index.append(docs.where("doc_id % 3 <> 0"), key="doc_id", columns=["text"])
    index.append(docs.where("doc_id % 3 = 0"), key="doc_id", columns=["text"])
    index.append(docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("Thing-onre "), "doc_id", F.lit(" thing"))), key="doc_id", columns=["text"])
    index.delete(docs.where("doc_id % 7 = 0"), key="doc_id")
    return index


@query("ret_10_reindexed", f"""WITH documents AS ({CHANGED}), {LEX},
found AS (SELECT * FROM lex) SELECT 'merged' AS state, * FROM found UNION ALL SELECT 'compacted', * FROM found""")
def ret_10(t: Tables):
    """New, changed and deleted documents are right when merged on read and after compaction."""
    index = _changed(t)
    before = index.lexical(SEARCH, key="doc_id", columns={"text": 1}).withColumn("state", F.lit("merged"))
    index.compact()
    return before.unionByName(index.lexical(SEARCH, key="doc_id", columns={"text": 1}).withColumn("state", F.lit("compacted")))


@query("ret_10_index_state", f"""
WITH now AS ({CHANGED}), runs AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \t-\r]+')) AS w FROM now), old AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \t-\r]+')) AS w FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0),
replaced AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, w FROM old WHERE w <> '')), extra AS (SELECT 3 * count(*) AS n FROM documents WHERE doc_id % 35 = 0)
SELECT g AS generation, b AS batches, (SELECT count(*) FROM now) AS live_keys, (SELECT count(*) FROM (SELECT DISTINCT doc_id, w FROM runs WHERE w <> '')) AS live_postings, CASE WHEN g = 0 THEN (SELECT n FROM replaced) + (SELECT n FROM extra) ELSE 0 END AS dead_postings
FROM (VALUES (0, 4), (1, 1)) s(g, b)""")
def ret_10_state(t: Tables):
    index = _changed(t)
    before = index.status()
    index.compact()
    return before.unionByName(index.status())
