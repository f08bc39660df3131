"""Hand-made rows for the corners of each operator."""

from __future__ import annotations

from datetime import date, datetime

import pytest

import salesaudit as audit
from salesaudit.functions import exprs
from salesaudit.catalogue.queries import SHOWN
from salesaudit.sources.schema import IDENTIFIERS


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def pay(*amounts, **common):
    return [{"total_payment": amount, **common} for amount in amounts]


# --- empty table ----------------------------------------------------------


def test_empty_table_profiles_are_null_not_zero(make):
    empty = make()
    overview = audit.dataset_overview(empty).first()
    assert overview["total_rows"] == 0 and overview["null_payment"] == 0
    for name in ("total_revenue", "average_payment", "payment_stddev", "earliest_transaction"):
        assert overview[name] is None
    statistics = audit.payment_statistics(empty).first().asDict()
    assert statistics.pop("non_null_payments") == 0
    assert set(statistics.values()) == {None}


def test_empty_table_reports(make):
    empty = make()
    assert {row["missing_percentage"] for row in audit.missing_by_column(empty).collect()} == {None}
    assert rows(audit.product_type_performance(empty)) == []
    assert rows(audit.identifier_uniqueness(empty)) == [(name, 0, 0, 0, 0) for name in IDENTIFIERS]
    assert set(audit.identifier_uniqueness_wide(empty).first()) == {0}
    assert rows(audit.duplicate_transaction_rows(empty)) == [(0, 0)]
    assert rows(audit.revenue_concentration(empty)) == []
    assert rows(audit.revenue_concentration_full(empty)) == []
    assert len(rows(audit.audit_flags(empty))) == 8


# --- payments -------------------------------------------------------------


def test_thresholds_are_strict_and_signs_add_up(make):
    sales = make(*pay(None, -5, 0, 10000, "10000.01", 50000, "50000.01", 100000, "100000.01"))
    found = audit.financial_anomalies(sales).first()
    assert found["payments_over_10000"] == 5
    assert found["payments_over_50000"] == 3
    assert found["payments_over_100000"] == 1
    assert found["negative_payment_value"] == -5.0
    assert found["zero_payment_value"] == 0.0
    assert found["payments_over_100000_value"] == 100000.01
    signs = audit.payment_sign_counts(sales).first()
    assert tuple(signs) == (1, 1, 6, 1)
    assert sum(signs) == sales.count()
    assert audit.financial_anomalies_nonneg(sales).first()["nonnegative_payments"] == 7


def test_sum_over_no_rows_is_null(make):
    found = audit.financial_anomalies(make(*pay(1, 2))).first()
    assert found["negative_payments"] == 0 and found["negative_payment_value"] is None


@pytest.mark.parametrize(
    "amounts",
    [
        ["1.00"],
        ["1.00", "2.00"],
        ["-3.50", "-3.50", "0.00", None, "9999.99", "10000.00", "10000.01"],
        ["0.01", "123456789012.34", "-123456789012.34", "20000000000.00", "5.00"],
        [str(i * i % 977) + ".25" for i in range(300)],
    ],
)
def test_percentiles_equal_the_builtin(make, amounts):
    from pyspark.sql import functions as F

    points = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.9, "f": 0.99, "g": 1.0}
    sales = make(*pay(*amounts))
    exact = audit.payment_percentiles(sales, **points).first()
    builtin = sales.agg(F.percentile(F.col("total_payment").cast("double"), list(points.values()))).first()[0]
    assert list(exact) == pytest.approx(builtin, rel=1e-12)


# --- breakdowns -----------------------------------------------------------


def test_null_revenue_sorts_first_and_shares_skip_it(make):
    sales = make(
        *pay(10, 20, product_type="Ticket"), *pay(None, product_type="Resale"), *pay(5, product_type=None)
    )
    found = rows(audit.product_type_performance(sales))
    assert [line[0] for line in found] == ["Resale", "Ticket", "[NULL]"]
    assert found[0][1:] == (1, 25.0, None, None, None, None, None)
    assert found[1][1:] == (2, 50.0, 30.0, 85.7143, 15.0, 10.0, 20.0)


def test_label_next_to_the_literal_text(make):
    sales = make(
        *pay(1, product_type=None, price_level=None), *pay(2, product_type="[NULL]", price_level="[NULL]")
    )
    assert sorted(line[:2] for line in rows(audit.product_type_performance(sales))) == [("[NULL]", 1)] * 2
    assert rows(audit.price_level_performance(sales)) == [("[NULL]", 2, 3.0, 1.5)]


def test_total_revenue_of_zero_gives_no_share(make):
    found = audit.sale_type_performance(make(*pay(0, 0, sale_type="Sale"))).first()
    assert found["revenue"] == 0.0 and found["revenue_percentage"] is None


def test_hospitality_labels(make):
    sales = make(*({"is_hospitality": flag, "total_payment": 1} for flag in (True, False, False, None)))
    assert sorted(line[:2] for line in rows(audit.hospitality_performance(sales))) == [
        ("Hospitality", 1),
        ("Non-Hospitality", 2),
        ("[NULL]", 1),
    ]
    assert rows(audit.hospitality_basic(sales))[0][:2] == ("false", 2)
    assert sorted(line[0] for line in rows(audit.hospitality_basic(sales))) == ["NULL", "false", "true"]
    assert [line[0] for line in rows(audit.hospitality_summary(sales))] == [False, True, None]


def test_rounding_is_half_up_on_decimals(make):
    sales = make(*pay("0.01", "0.02", product_type="a"), *pay("1.00", product_type="b"))
    basic = {line[0]: line for line in rows(audit.product_type_basic(sales))}
    assert basic["a"][4] == 0.02 and basic["a"][2] == 66.67
    assert audit.product_summary(sales).where("product_type = 'a'").first()["average_payment"] == 0.015


def test_top_lists_keep_the_best_and_break_ties_by_key(make):
    sales = make(*({"price_level": name, "total_payment": 1} for name in "cab"), {"price_level": "d"})
    assert [line[0] for line in rows(audit.top_price_levels(sales, 3))] == ["d", "a", "b"]


def test_blank_descriptions_are_left_out_of_the_top_list(make):
    names = ["x", "x", "", "   ", None, "\t"]
    sales = make(*({"product_description": name} for name in names))
    assert [line[0] for line in rows(audit.top_product_descriptions(sales))] == ["x", "\t"]
    assert len(rows(audit.product_description_performance(sales))) == 5


def test_accounts_per_rep_are_distinct(make):
    sales = make(
        {"sales_rep": "r", "internal_account_id": "1"},
        {"sales_rep": "r", "internal_account_id": "1"},
        {"sales_rep": "r", "internal_account_id": None},
        {"internal_account_id": "2"},
    )
    assert {line[0]: line[4] for line in rows(audit.sales_rep_performance(sales))} == {"r": 1, "[NULL]": 1}


def test_best_groups_prefer_a_payment(make):
    sales = make(
        *pay(None, product_type="a", application_channel="x"),
        *pay(1, product_type="c", application_channel="y"),
        *pay(1, product_type="b", application_channel="y"),
    )
    assert rows(audit.top_groups(sales)) == [("product_type", "b", 1.0), ("application_channel", "y", 2.0)]


# --- dates ----------------------------------------------------------------


def test_periods_at_their_borders(make):
    sales = make(
        *(
            {"transaction_date": moment, "transaction_id": key, "total_payment": 1}
            for moment, key in (
                (datetime(2023, 12, 31, 23, 59, 59, 999000), "a"),
                (datetime(2024, 1, 1), "a"),
                (datetime(2024, 1, 31, 23, 59, 59, 999000), "a"),
                (datetime(2024, 3, 1), "b"),
                (None, "c"),
            )
        )
    )
    assert rows(audit.monthly_trend(sales)) == [
        (date(2023, 12, 1), 1, 1.0, 1.0, 1),
        (date(2024, 1, 1), 2, 2.0, 1.0, 1),
        (date(2024, 3, 1), 1, 1.0, 1.0, 1),
    ]
    assert [line[:2] for line in rows(audit.yearly_trend(sales))] == [(2023, 1), (2024, 3)]
    assert [line[:2] for line in rows(audit.yearly_sales(sales))] == [(2023, 1), (2024, 3), (None, 1)]
    assert rows(audit.monthly_sales(sales))[0][0] == datetime(2023, 12, 1)
    assert rows(audit.monthly_sales(sales))[-1][0] is None
    assert rows(audit.yearly_totals(sales))[-1] == (None, 1, 1.0)


def test_date_consistency(make):
    touched = datetime(2020, 1, 1, 12)
    sales = make(
        {"transaction_date": touched, "last_touched_at": touched},
        {"transaction_date": datetime(2020, 1, 1, 13), "last_touched_at": touched},
        {"transaction_date": datetime(2009, 12, 31, 23, 59, 59), "last_touched_at": None},
        {"transaction_date": datetime(2010, 1, 1), "last_touched_at": touched},
        {},
    )
    found = audit.date_consistency_full(sales, "2020-01-01 12:00:00").first()
    assert tuple(found)[:5] == (1, 2, 1, 1, 1)
    assert tuple(found)[5:] == (datetime(2009, 12, 31, 23, 59, 59), datetime(2020, 1, 1, 13))
    assert audit.date_consistency_future(sales, "2020-01-01 13:00:00").first()["transaction_in_future"] == 0


@pytest.mark.parametrize("last, partial", [(datetime(2024, 2, 28, 23), True), (datetime(2024, 2, 29), False)])
def test_partial_month(make, last, partial):
    sales = make({"transaction_date": datetime(2024, 1, 5)}, {"transaction_date": last})
    flags = [line[-1] for line in rows(audit.monthly_trend_flagged(sales))]
    assert flags == [False, partial]
    issues = [line for line in rows(audit.business_issues(sales)) if line[0] == "Reporting period"]
    assert len(issues) == partial
    if partial:
        assert issues[0][2:4] == (
            "February 2024 is a partial month.",
            "The latest transaction date is February 28, 2024.",
        )
        assert issues[0][5] == "Flag February 2024 as partial in dashboards and reports."


# --- missing values -------------------------------------------------------


def test_blank_is_missing_but_a_tab_is_not(make):
    sales = make(*({"section": text, "product_type": "Ticket"} for text in ("", "   ", "\t", None, "1")))
    wide = audit.missing_wide(sales).first()
    assert wide["section_missing"] == 3 and wide["hospitality_null"] == 5
    assert "internal_account_id_missing" not in wide.asDict()
    assert audit.missing_wide_nulls(sales).first()["missing_section"] == 1
    long = {line[0]: line[1:] for line in rows(audit.missing_long(sales))}
    assert long["total_rows"] == (5, 100.0) and long["section_missing"] == (3, 60.0)
    nulls = {line[0]: line[1:] for line in rows(audit.missing_long_nulls(sales))}
    assert nulls["missing_section"] == (1, 20.0) and "total_rows" not in nulls
    by_column = {line[0]: line[1:] for line in rows(audit.missing_by_column(sales))}
    assert by_column["section"] == (1, 20.0) and len(by_column) == 27
    assert rows(audit.missing_by_product_type(sales)) == [("Ticket", 5, 5, 5, 1, 5, 5)]


def test_missing_covers_columns_the_schema_does_not_know(make):
    from pyspark.sql import functions as F

    sales = make({}, {}).withColumn("odd `name`.x", F.lit(None).cast("string"))
    assert {line[0]: line[1] for line in rows(audit.missing_by_column(sales))}["odd `name`.x"] == 2


# --- identifiers ----------------------------------------------------------


def test_identifier_counts(make):
    values = ["a", "b", "b", "c", "c", "c", None, " ", "c "]
    sales = make(*({"transaction_id": v, "total_payment": 1} for v in values))
    profile = {line[0]: line[1:] for line in rows(audit.identifier_uniqueness(sales))}
    assert profile["transaction_id"] == (8, 8, 5, 3)
    assert profile["product_id"] == (0, 0, 0, 0)
    assert audit.identifier_uniqueness_wide(sales).first()["unique_transaction_ids"] == 3
    assert dict((line[0], line[1:]) for line in rows(audit.duplicate_identifier_summary(sales)))[
        "transaction_id"
    ] == (8, 3)
    assert rows(audit.duplicate_transaction_ids(sales)) == [("c", 3), ("b", 2)]
    assert rows(audit.duplicate_transaction_ids(sales, 1)) == [("c", 3)]
    assert rows(audit.duplicate_transaction_rows(sales)) == [(2, 5)]
    assert [line[:3] for line in rows(audit.duplicate_transactions(sales))] == [("c", 3, 3.0), ("b", 2, 2.0)]
    assert rows(audit.duplicate_summary(sales)) == [
        ("sales_item_id", 0),
        ("transaction_id", 2),
        ("primary_ticket_id", 0),
    ]
    assert rows(audit.duplicate_transaction_ids(sales, None)) == [("c", 3), ("b", 2)]
    assert len(rows(audit.duplicate_transactions(sales, None))) == 2


def test_blank_groups_count_only_where_blanks_are_values(make):
    sales = make(*({"sales_item_id": v} for v in ("", "", " ", " ", "x", "x")))
    assert rows(audit.duplicate_summary(sales))[0] == ("sales_item_id", 1)
    assert rows(audit.duplicate_sales_items(sales)) == [("x", 2)]
    assert {line[0]: line[1] for line in rows(audit.duplicate_group_summary(sales))}["sales_item_id"] == 3


def test_grain(make):
    sales = make(
        {"product_type": "Ticket", "sale_type": "Sale", "primary_ticket_id": "1", "total_payment": 1},
        {"product_type": "Ticket", "sale_type": "Sale", "primary_ticket_id": " 1 ", "total_payment": 2},
        {"product_type": None, "sale_type": "Sale", "primary_ticket_id": "", "transaction_id": "t"},
    )
    assert rows(audit.potential_data_grain(sales)) == [
        ("Ticket", "Sale", 2, 1, 0, 0, 0, 3.0),
        (None, "Sale", 1, 0, 0, 1, 0, None),
    ]


# --- accounts -------------------------------------------------------------


def test_concentration_with_ties_and_null_revenue(make):
    amounts = {"a": 5, "b": 5, "c": None, "d": 90}
    sales = make(*({"internal_account_id": k, "total_payment": v} for k, v in amounts.items()), {"total_payment": 7})
    expected = [
        ("c", None, None, None),
        ("d", 90.0, 90.0, 90.0),
        ("a", 5.0, 5.0, 95.0),
        ("b", 5.0, 5.0, 100.0),
    ]
    assert rows(audit.revenue_concentration(sales)) == expected
    assert sorted(rows(audit.revenue_concentration_full(sales))) == sorted(expected, key=lambda r: r[0])
    assert rows(audit.revenue_concentration(sales, 2)) == expected[:2]


def test_concentration_of_no_revenue(make):
    sales = make({"internal_account_id": "a", "total_payment": 0})
    assert rows(audit.revenue_concentration(sales)) == [("a", 0.0, None, None)]


def test_largest_rows_skip_null_payments(make):
    sales = make(*({"transaction_id": str(i), "total_payment": p} for i, p in enumerate((None, 1, 3, 3))))
    assert [row["transaction_id"] for row in audit.high_value_transactions(sales).collect()] == ["2", "3", "1"]
    assert [row["transaction_id"] for row in audit.largest_transactions(sales, 1).collect()] == ["2"]


# --- absent columns -------------------------------------------------------


@pytest.mark.parametrize(
    "operator, column",
    [
        (audit.missing_by_product_type, "product_type"),
        (audit.duplicate_transactions, "transaction_id"),
        (audit.hospitality_performance, "is_hospitality"),
        (audit.price_level_performance, "price_level"),
        (audit.price_type_performance, "price_type"),
        (audit.sales_rep_performance, "sales_rep"),
        (audit.transfer_status, "transfer_status"),
        (audit.resale_status, "resale_status"),
        (audit.product_description_performance, "product_description"),
        (audit.account_activity, "internal_account_id"),
        (audit.revenue_concentration, "internal_account_id"),
    ],
)
def test_absent_column_gives_no_rows_but_the_same_schema(make, operator, column):
    sales = make(*pay(1, 2))
    without = operator(sales.drop(column))
    assert without.schema == operator(sales).schema
    assert without.collect() == []


def test_absent_identifiers_are_left_out(make):
    sales = make({"transaction_id": "t"}).drop("product_id", "primary_ticket_id")
    names = [line[0] for line in rows(audit.identifier_uniqueness(sales))]
    assert names == [n for n in IDENTIFIERS if n not in ("product_id", "primary_ticket_id")]
    issues = [line[2] for line in rows(audit.business_issues(sales, 1))]
    assert "Missing primary_ticket_id values exist." not in issues
    assert "Missing subscription_instance_id values exist." in issues


# --- findings -------------------------------------------------------------


def test_row_count_reconciliation(make):
    sales = make(*pay(1, 2))
    match, differ = audit.row_count_reconciliation(sales, 2), audit.row_count_reconciliation(sales, 3000)
    assert rows(audit.row_count_reconciliation(sales)) == []
    assert [line[1:4:2] for line in rows(match)] == [("INFO", "2 records audited.")]
    assert [line[1:4:2] for line in rows(differ)] == [("HIGH", "Found 2; expected 3,000.")]


def test_every_issue_rule_fires_in_order(make):
    sales = make(
        *pay(None, 0, -1, "100000.01", transaction_id="t", transaction_date=datetime(2024, 3, 30))
    )
    found = rows(audit.business_issues(sales, 4, "2024-01-01 00:00:00"))
    assert [line[1] for line in found] == [
        "INFO",
        "HIGH",
        "REVIEW",
        "HIGH",
        "REVIEW",
        "HIGH",
        "REVIEW",
        "REVIEW",
        "INFO",
        "REVIEW",
    ]
    assert found[4][3] == "1 transactions exceed $100,000."
    assert found[-1][3] == "1 duplicate transaction groups are present in the table."
    assert len(rows(audit.business_issues(sales, 4))) == 9


def test_duplicate_issue_counts_all_groups(make):
    sales = make(*({"transaction_id": str(i // 2)} for i in range(10)))
    assert rows(audit.business_issues(sales))[-1][3].startswith("5 duplicate")


def test_flags(make):
    sales = make({"primary_ticket_id": " ", "total_payment": 0, "is_hospitality": True})
    flags = rows(audit.audit_flags(sales))
    assert [line[1] for line in flags] == [
        "PASS",
        "PASS",
        "PASS",
        "REVIEW",
        "REVIEW",
        "PASS",
        "REVIEW",
        "REVIEWED",
    ]
    assert flags[4][2] == "1 blank/NULL primary ticket IDs"


def test_scorecard_and_summary(make):
    sales = make(*pay(1, 2, product_id="p", transaction_date=datetime(2024, 1, 2, 3, 4, 5, 678000)))
    card = rows(audit.quality_scorecard(sales, "2025-01-01 00:00:00", expected_rows=3))
    assert [line[1] for line in card] == ["FAIL"] + ["PASS"] * 10 + ["REVIEW"]
    assert card[0][2] == "Dataset contains 2 rows; expected 3."
    assert card[-1][2] == "1 duplicate product_id groups were detected."
    assert card[6][2:] == ("No duplicate primary_ticket_id groups were detected.", "No action required.")
    summary = dict(rows(audit.executive_summary(sales, "2025-01-01 00:00:00")))
    assert summary == {
        "Total rows": "2",
        "Earliest transaction": "2024-01-02 03:04:05.678000",
        "Latest transaction": "2024-01-02 03:04:05.678000",
        "Total payment": "3.00",
        "Average payment": "1.5000",
        "Minimum payment": "1.00",
        "Maximum payment": "2.00",
        "PASS checks": "11",
        "REVIEW checks": "1",
        "FAIL checks": "0",
    }


def test_report_text(make):
    sales = make(
        *pay("1234.5", product_type="a|b", application_channel="x"), *pay(None, product_type=None)
    )
    assert sorted(rows(audit.report_product(sales))) == [
        ("[NULL]", "1", "$0.00", "$0.00", "0.00%"),
        ("a/b", "1", "$1,234.50", "$1,234.50", "100.00%"),
    ]


def test_chart_series_positions(make):
    sales = make(
        *(
            {"product_type": f"p{i:02}", "total_payment": i, "transaction_date": datetime(2000 + i, 1, 1)}
            for i in range(1, 21)
        )
    )
    assert audit.chart_series(sales).where("series = 'product_revenue'").count() == 20
    points = audit.chart_series(sales, shown=SHOWN).collect()
    series = {}
    for row in points:
        series.setdefault(row["series"], []).append((row["position"], row["label"], row["value"]))
    assert len(series["product_revenue"]) == 15 and series["product_revenue"][0] == (1, "p20", 20.0)
    assert len(series["product_records"]) == 10 and series["product_records"][0] == (1, "p01", 1.0)
    assert len(series["yearly_records"]) == 20 and len(series["yearly_records_top"]) == 10
    assert series["yearly_revenue"][0] == (1, "2001", 1.0)
    assert [label for _, label, _ in series["payment_percentiles"]] == [
        "P01",
        "P05",
        "P25",
        "Median",
        "P75",
        "P90",
        "P95",
        "P99",
    ]
    assert len(series["missing_share"]) == 27 and len(series["missing_count"]) == 12


# --- expressions ----------------------------------------------------------


def test_expressions(spark, make):
    from pyspark.sql import functions as F

    frame = make({"sales_details": "a|b", "price_type": "12.5", "price_level": "x1"}, {})
    assert exprs.resolve_column(frame, ["rows", "seat", "row"]) == "seat"
    assert exprs.resolve_column(frame, ["rows"]) is None
    assert exprs.existing(frame, ["seat", "nope", "row"]) == ["seat", "row"]
    first = frame.select(
        exprs.cell_text(F.col("sales_details")),
        exprs.to_number(F.col("price_type")),
        exprs.to_number(F.col("price_level")),
    ).first()
    assert tuple(first) == ("a/b", 12.5, None)
    text = spark.range(1).select(
        exprs.money_text(F.lit(-1234.5)),
        exprs.money_text(F.lit(None).cast("double"), "N/A"),
        exprs.count_text(F.lit(1234.9)),
        exprs.count_text(F.lit(1234.9), whole=False),
        exprs.count_text(F.lit(None).cast("bigint"), "N/A"),
        exprs.percent_text(F.lit(1234.567)),
        exprs.percent_text(F.lit(None).cast("double"), "N/A"),
    )
    assert tuple(text.first()) == ("$-1,234.50", "N/A", "1,234", "1,235", "N/A", "1234.57%", "N/A")
