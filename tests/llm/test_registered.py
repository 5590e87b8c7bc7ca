import re


def test_registration_and_contract_columns(spark):
    import __spark_entry__ as entry
    from tests.conftest import SF_SMALL
    queries = entry.queries()
    ops = {int(m[1]): k for k in queries if (m := re.match(r"op(\d+)_", k))}
    assert sorted(ops) == list(range(1, 14)) and "pipeline" in queries
    want = {
        1: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        2: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        3: "doc_id held_out score predicted", 5: "doc_id held_out lang_pred score",
        6: "page_id host path rule verdict", 7: "doc_id size source_size target taken",
        8: "doc_id n_lines n_dropped kept_sha256",
        9: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        10: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        11: "item_id rank doc_id score",
        12: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
        13: "doc_id n_tokens ids_sha256 decoded_sha256"}
    for n, columns in want.items():
        out = queries[ops[n]](spark, SF_SMALL)
        assert out.columns[:len(columns.split())] == columns.split(), ops[n]


def test_oracles_agree(spark):
    import duckdb
    import __spark_entry__ as entry
    from tests.conftest import SF_SMALL
    from tools.oracle_check import TABLES, digest
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            df, rel = entry.queries()[name](spark, SF_SMALL), con.sql(sql)
            assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(rel.columns, rel.fetchall())[0], name
