import os

import oracle
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def test_all_problems_are_registered(entry):
    names = entry.queries()
    for n in "p1_found p2_found p3_containers p4_found p5_found p6_ids p7_found p8_found".split():
        assert n in names


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_containers", "p3_utilisation", "p4_found", "p4_rates", "p5_found", "p6_ids", "p7_found", "p8_found", "p8_redacted", "p2_redacted", "p1_shares"])
def test_runs_without_repeats(spark, entry, name):
    if name == "p6_ids" and not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"):
        pytest.skip("no vocabulary here")
    df = entry.queries()[name](spark, SF.replace("0.001", "0.01") if name == "p7_found" else SF)
    n = df.count()
    assert n > 0 and df.distinct().count() == n


def test_sql(spark, entry):
    con = oracle.connect(SF)
    for name, sql in entry.oracle_sql().items():
        if name[:1] == "p" and name[1:2].isdigit():
            assert oracle.difference(entry.queries()[name](spark, SF), con, sql) is None
