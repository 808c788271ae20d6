import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import DATA, check

from listweave.llm.queries import _KEYS, ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    if not DATA.exists():
        pytest.skip("no test tables here")
    n = QUERIES[name](spark, str(DATA)).count()
    assert n > 0 or name == "p2_disproved"


def test_errors_of_the_filter_against_the_records(spark):
    """What the log and the report say can be decided from the records, but for how many the filter lets through."""
    if not DATA.exists():
        pytest.skip("no test tables here")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("rules", "incoming_rules"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    sql = _KEYS + ", x AS (SELECT rec_id, seen, count(*) OVER (PARTITION BY a.k) AS held FROM d JOIN a USING (rec_id)) SELECT count(*), count(*) FILTER (seen), count(*) FILTER (NOT seen AND held > 1), list(rec_id) FILTER (NOT seen AND held = 1) FROM x"
    records, confirmed, first, alone = con.execute(sql).fetchone()
    r = QUERIES["p2_error_report"](spark, str(DATA)).first()
    wrong = {x["rec_id"] for x in QUERIES["p2_disproved"](spark, str(DATA)).collect()}
    assert (r["records"], r["confirmed"], r["first_of_repeats"], r["disproved"]) == (records, confirmed, first, len(wrong))
    assert wrong <= set(alone) and r["positives"] == confirmed + first + len(wrong) and r["filter_negatives"] == len(alone) - len(wrong)
    assert r["false_positive_rate"] == len(wrong) / len(alone)


def test_subject_reports_agree(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    units = {(r["doc_id"], r["subject"]): r["units"] for r in QUERIES["p8_mixtures"](spark, str(DATA)).collect()}
    found = {tuple(r) for r in QUERIES["p8_found"](spark, str(DATA)).collect()}
    assert found and found == {k for k, n in units.items() if n >= 3}
    for r in QUERIES["p8_composition"](spark, str(DATA)).collect():
        assert r["documents"] == sum(s == r["subject"] for _, s in found)
        assert r["units"] == sum(n for (_, s), n in units.items() if s == r["subject"])
