"""Queries that use the claims several times derive them from the order tables once."""

import pytest

from claimsieve.catalog import checks, common, evaluation, files


@pytest.mark.parametrize(
    "name, query", [("write_tables", files.write_tables), ("check_relabel", checks.check_relabel), ("check_result", checks.check_result), ("scheme_report", evaluation.scheme_report)]
)
def test_claims_are_derived_once(spark, sf_dir, monkeypatch, name, query):
    calls = []
    derive = common.order_claims

    def counted(*args):
        calls.append(args)
        return derive(*args)

    for module in (common, checks):
        monkeypatch.setattr(module, "order_claims", counted)
    out = query(spark, sf_dir)
    assert len(calls) == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # what is left to run reads the written claims
