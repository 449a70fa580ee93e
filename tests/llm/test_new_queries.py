"""Registered queries of this subpackage against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidemill.llm import oracles, queries


@pytest.mark.parametrize("name,table,sql", [("op11_negatives", "embeddings", oracles.NEGATIVES), ("op13_divergence", "documents", oracles.DIVERGENCE)])
def test_query_equals_sql(spark, sf, name, table, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf, table)}.parquet'")
    want = con.execute(sql)
    columns = [x[0] for x in want.description]
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, sf).select(*columns).collect())
    assert got == sorted(want.fetchall()) and got


def test_bpe_query_equals_the_library(spark, sf):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{os.path.join(sf, 'documents')}.parquet'").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[doc_id] = (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_bpe"](spark, sf).collect()} == want
