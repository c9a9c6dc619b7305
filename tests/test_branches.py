"""The registered inputs reach the branches that their operators exist for."""

import os

import pytest

SF_SMALL = "/root/testdata/sf0.01"

from lacuna.plans.registry_more import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver test data not present")


@pytest.fixture(scope="module")
def rows(spark):
    def run(name):
        return QUERIES[name][0](spark, SF_SMALL).collect()

    return run


def test_names_hit_and_miss(rows):
    for name, column in (("p12_pooled_fund_known", "country"), ("p12b_map_name_known", "iso3")):
        codes = {r[column] for r in rows(name)}
        assert "UNK" in codes and len(codes) > 5, name


def test_scope_leaves_rows_out(rows):
    got = rows("w1_rank_tight_scope")
    assert {r.is_in_scope for r in got} == {True, False}
    assert all((r.global_rank > 0) == r.is_in_scope for r in got)
    ranks = sorted(r.global_rank for r in got if r.global_rank)
    assert ranks == list(range(1, len(ranks) + 1))


def test_every_rule_fails_somewhere(rows):
    assert {x for r in rows("q1_quarantine_broken") for x in r.failed_rules.split(",")} == {"iso3_missing", "year_out_of_range", "funding_negative"}
    assert all(r.failures > 0 for r in rows("q3_rule_counts_broken"))
    assert all(r.failures > 0 for r in rows("q2_observed_counts"))


def test_replies_parse_and_fail(rows):
    good, bad = rows("s4_fenced_replies"), rows("s4_quarantined_replies")
    assert any(r.event_id % 3 == 0 for r in good) and all(r.k is not None for r in good)
    assert any("error" in r.reply for r in bad) and any("error" not in r.reply for r in bad)


def test_other_branches(rows):
    assert rows("j15_needs_without_dropped_plan")
    severity = [r.Severity_Index for r in rows("f19_concentrated_need")]
    assert any(s > 0.5 for s in severity) and any(s <= 0.5 for s in severity)
    assert {r.position for r in rows("t4_worst_three_sectors")} == {1, 2, 3}
    cards = rows("f17_insight_cards")
    assert {r.card_type for r in cards} == {"FUNDING_GAP", "MISMATCH_RANK", "DONOR_RISK", "SECTOR_BREAKDOWN"}
    assert {r.b is None for r in rows("s1_csv_rows")} == {True, False}
    assert {r.copies for r in rows("s8_table_writes")} == {1, 2}


def test_build_time_is_optional(spark):
    from lacuna.plans import medallion as P

    g = P.score(P.base_index(spark, SF_SMALL), updated_at=True)
    assert g.columns == [*P.GOLD_COLUMNS, "updated_at"] and g.first().updated_at is not None
