"""Every registered query: contract columns, whole tables, and its SQL where there is one."""
import duckdb
import pytest

import __spark_entry__ as entry
from inkstone.llm import queries

SMALL = "/root/testdata/sf0.001"
#: The result columns that each query must have at least.
COLUMNS = {
    "op1_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op3_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op5_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_token_counts": "doc_id section start end n_tokens",
    "op7_near_dedup": "doc_id n_shingles component_id kept",
    "op8_quality": "doc_id expected_grade p_top kept",
    "op9_source_mix": "doc_id size source_size target taken",
    "op10_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_cross_tokenizer": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12_source_divergence": "lang source part item value rank",
    "op13_token_files": "doc_id start n_tokens ids_crc32",
}
#: Table and column whose values the result must hold all of.
TABLE = {"op2_warc": ("pages", "page_id"), "op12_source_divergence": ("documents", "source")}


def value(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    got = df.collect()
    table, key = TABLE.get(name, ("documents", "doc_id"))
    assert {r[key] for r in got} == {r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()}
    sql = entry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        want = [tuple(map(value, r)) for r in result.fetchall()]
        assert sorted((tuple(value(r[c]) for c in names) for r in got), key=repr) == sorted(want, key=repr)


def test_all_queries_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS)
    assert set(COLUMNS) | {"pipeline"} <= set(entry.queries())
