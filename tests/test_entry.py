"""The entry module keeps its contract, with and without the removable parts."""

import duckdb
import pytest

import __spark_entry__
from helixmill.plans import fixtures

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["m1_brackets_to_pairs", "l2_classify_loops", "g2_corpus_feature_counts", "a2_sequence_weights", "m3_validate_mapping", "m4_has_pseudoknot", "t5_l1_shrink", "t7_epoch_order", "k5_report", "m7_attach_valid_structures", "e1_normalize_words", "k3_o1_order_of_weights", "s1_detect_format", "s2_s3_alignments", "s4_raw", "s6_reactivity", "s5_s7_corpus"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    tidy = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    nulls = lambda rows: sorted(tuple((v is not None, v) if v is not None else (False, 0) for v in r) for r in rows)
    got = __spark_entry__.queries()[name](spark, SF).select(*cols).collect()
    key = nulls if any(v is None for r in got for v in r) else tidy
    assert key([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got]) == key([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in cur.fetchall()])


def test_whole_queries_have_no_span(spark, tmp_path):
    letters = "".join(chr(97 + k * k * 7 % 26) for k in range(1, 79)) * 2
    spark.createDataFrame([(0, letters), (4, letters[5:60])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql, queries = __spark_entry__.oracle_sql(), __spark_entry__.queries()
    bases = fixtures.fx_seq(spark, str(tmp_path)).collect()
    count = {x.seq_id: sum(x.seq[i] + x.seq[j] in ("AU", "UA", "CG", "GC", "GU", "UG") for i in range(78) for j in range(i + 1, 78)) for x in bases}
    assert {x.seq_id: x.n for x in queries["j1_candidate_pairs_whole"](spark, str(tmp_path)).collect()} == count
    for name in [n for n in queries if n.endswith("_whole")]:
        cur = con.execute(sql[name])
        cols = [c[0] for c in cur.description]
        tidy = lambda rows: sorted(tuple(round(float(v), 5) for v in r) for r in rows)
        got = tidy(queries[name](spark, str(tmp_path)).select(*cols).collect())
        assert got == tidy(cur.fetchall()), name
    assert tidy(con.execute(sql["j1_candidate_pairs_whole"]).fetchall()) != tidy(con.execute(sql["j1_candidate_pairs"]).fetchall())
