"""The numbered queries as registered, on the smallest tables: against their SQL, and their contracts' columns."""

import zlib

import duckdb
import pandas as pd
import pytest

from codequarry.llm import queries as Q
from tests.test_queries import TABLES, rows

SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, sf_dir, name):
    ours, theirs = Q.queries()[name](spark, sf_dir).toPandas(), db.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


CONTRACTS = {
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_leaks": {"doc_id": "bigint", "item_id": None},
    "op10_urls": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
}


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(SQL)))
def test_columns(spark, sf_dir, name):
    out = Q.queries()[name](spark, sf_dir)
    kinds = dict(out.dtypes)
    assert all(kinds[c] == k or k is None and c in kinds for c, k in CONTRACTS[name].items())
    rows = out.toPandas()
    if "held_out" in kinds:
        assert rows["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows["doc_id"]] and rows["score"].between(0, 1).all()
    if name != "op8_leaks":
        assert len(rows) == spark.read.parquet(f"{sf_dir}/{'pages' if 'page_id' in kinds else 'documents'}.parquet").count()


def test_toxicity_on_held_out_rows(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.1")
    rows = Q.queries()["op2_toxicity"](spark, larger).toPandas().merge(pd.read_parquet(f"{larger}/labels.parquet"), on="doc_id")
    assert rows["predicted"].tolist() == (rows["score"] >= 0.3).astype(int).tolist()
    rows = rows[rows["held_out"] & rows["toxic"].notna()]
    bad, good = rows[rows["toxic"] == 1]["score"].to_numpy(), rows[rows["toxic"] == 0]["score"].to_numpy()
    above = (bad[:, None] > good).mean() + 0.5 * (bad[:, None] == good).mean()
    assert len(bad) > 50 and above > 0.97
    assert (good < 0.3).mean() > 0.95
