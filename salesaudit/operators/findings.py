"""Findings derived from the figures: issues, flags, scorecard, key figures.

The inputs are one-row frames of counts. Every rule is a column expression over
that row, so a whole register is one plan and nothing passes the driver.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesaudit.functions.exprs import as_double, attach, count_text, lines, mean_text, named
from salesaudit.operators.breakdown import top_groups
from salesaudit.operators.identifiers import identifier_profile
from salesaudit.operators.overview import (
    average_payment,
    dataset_coverage,
    payment_percentiles,
    table_facts,
    total_revenue,
    whole_table,
)
from salesaudit.sources.schema import ITEM_IDENTIFIERS

# Texts of the issue register, in order of emission.
# name: (category, severity, issue, business impact, recommended action)
ISSUES = {
    "rows_match": (
        "Data completeness",
        "INFO",
        "Dataset row count matches the verified updated dataset.",
        "Supports confidence in the current database load.",
        "Retain this dataset as the current audit baseline.",
    ),
    "rows_differ": (
        "Data completeness",
        "HIGH",
        "Dataset row count differs from the verified baseline.",
        "Analysis may not represent the complete source dataset.",
        "Reconcile the source file and database load.",
    ),
    "null_payments": (
        "Revenue data",
        "HIGH",
        "Payment values are missing.",
        "Revenue reporting may be incomplete.",
        "Investigate missing payment records.",
    ),
    "zero_payments": (
        "Revenue data",
        "REVIEW",
        "Zero-payment transactions exist.",
        "May represent complimentary, adjusted, test, or non-revenue transactions.",
        "Classify zero-payment transactions by business purpose.",
    ),
    "negative_payments": (
        "Revenue data",
        "HIGH",
        "Negative payment values exist.",
        "Could affect revenue reporting and reconciliation.",
        "Reconcile negative values against refunds, credits, or reversals.",
    ),
    "high_payments": (
        "Transaction monitoring",
        "REVIEW",
        "Very high-value transactions require validation.",
        "Unusual values can materially affect aggregate revenue.",
        "Validate high-value transactions against source-system records.",
    ),
    "future_dates": (
        "Date quality",
        "HIGH",
        "Future transaction dates were detected.",
        "Can distort reporting periods and forecasting.",
        "Investigate timestamp generation and source-system clocks.",
    ),
    "missing_identifier": (
        "Data completeness",
        "REVIEW",
        "Missing {} values exist.",
        "May affect customer, ticket, or subscription-level analysis.",
        "Interpret missingness by product type before labeling it as an error.",
    ),
    "partial_month": (
        "Reporting period",
        "INFO",
        "{} is a partial month.",
        "Monthly comparisons can be misleading if partial periods are treated as complete.",
        "Flag {} as partial in dashboards and reports.",
    ),
    "duplicates": (
        "Duplicate transactions",
        "REVIEW",
        "Repeated transaction IDs were detected.",
        "Could represent legitimate multi-line transactions or duplicate records.",
        "Investigate transaction grain before deduplicating.",
    ),
}

# Identifiers whose absence is an issue.
REQUIRED_IDENTIFIERS = ("primary_ticket_id", "subscription_instance_id")

REGISTER = ("category", "severity", "issue", "evidence", "business_impact", "recommended_action")


def _sentence(template: str, *values: Column) -> Column:
    """Text with each ``{}`` replaced by a value."""
    return F.format_string(template.replace("%", "%%").replace("{}", "%s"), *values)


def _issue(rule: str, evidence: Column, fires: Column | None = None, about: Column | None = None) -> Column:
    category, severity, issue, impact, action = ISSUES[rule]

    def text(template: str) -> Column:
        return _sentence(template, about) if "{}" in template else F.lit(template)

    values = (F.lit(category), F.lit(severity), text(issue), evidence, F.lit(impact), text(action))
    line = F.struct(*(value.alias(name) for value, name in zip(values, REGISTER)))
    return line if fires is None else F.when(fires, line)


def row_count_reconciliation(
    sales: DataFrame, expected_rows: int | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """The first line of the register: actual against expected row count; no
    line if none is expected."""
    facts = facts or table_facts(sales)
    return lines(facts, _row_count_rules(expected_rows)).select(*REGISTER)


def _row_count_rules(expected_rows: int | None) -> list[Column]:
    rows, expected = F.col("total_rows"), F.lit(expected_rows).cast("bigint")
    return [
        _issue("rows_match", _sentence("{} records audited.", count_text(rows)), rows == expected),
        _issue(
            "rows_differ",
            _sentence("Found {}; expected {}.", count_text(rows), count_text(expected)),
            rows != expected,
        ),
    ]


def _counted(rule: str, count: Column, template: str, about: Column | None = None) -> Column:
    return _issue(rule, _sentence(template, count_text(count)), count > 0, about)


def _issue_rules(facts: DataFrame, expected_rows: int | None) -> list[Column]:
    """One struct per rule over the whole-table row with its duplicate count;
    NULL where the rule does not fire."""
    names = [name for name in REQUIRED_IDENTIFIERS if f"null {name}" in facts.columns]
    latest = F.col("latest_transaction")
    groups = F.col("duplicates.repeated_values")
    return [
        *_row_count_rules(expected_rows),
        _counted("null_payments", F.col("null_payments"), "{} records have NULL total_payment."),
        _counted("zero_payments", F.col("zero_payments"), "{} records have a zero payment."),
        _counted("negative_payments", F.col("negative_payments"), "{} records have negative payments."),
        _counted("high_payments", F.col("payments_over_100000"), "{} transactions exceed $100,000."),
        _counted("future_dates", F.col("transaction_in_future"), "{} records occur after the audit timestamp."),
        *(
            _counted(
                "missing_identifier",
                named(f"null {name}"),
                "{} records are missing the identifier.",
                about=F.lit(name),
            )
            for name in names
        ),
        _issue(
            "partial_month",
            _sentence("The latest transaction date is {}.", F.date_format(latest, "MMMM d, yyyy")),
            fires=latest.cast("date") < F.last_day(latest.cast("date")),
            about=F.date_format(latest, "MMMM yyyy"),
        ),
        _counted(
            "duplicates", groups, "{} duplicate transaction groups are present in the table."
        ),
    ]


def _with_duplicates(facts: DataFrame, sales: DataFrame, profile: DataFrame | None) -> DataFrame:
    profile = profile or identifier_profile(sales, ["transaction_id"])
    repeated = profile.where(F.col("identifier") == "transaction_id").select("repeated_values")
    return attach(facts, duplicates=repeated)


def business_issues(
    sales: DataFrame,
    expected_rows: int | None = None,
    as_of: str | datetime | None = None,
    facts: DataFrame | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """The issue register. ``facts`` is a kept :func:`whole_table`.

    ``as_of`` switches the rule on future dates on, ``expected_rows`` the line
    on the row count. All duplicate groups count. The partial-month line names the month of the latest sale and stays out if that
    month is complete.
    """
    facts = facts or whole_table(sales, as_of)
    rules = _issue_rules(facts, expected_rows)
    return lines(_with_duplicates(facts, sales, profile), rules).orderBy("position").select(*REGISTER)


# --- key figures ----------------------------------------------------------


def _figures(row: DataFrame, figures: dict[str, Column]) -> DataFrame:
    structs = [F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in figures.items()]
    return lines(row, structs).orderBy("position").select("metric", "value")


def executive_kpis(
    sales: DataFrame,
    expected_rows: int | None = None,
    as_of: str | datetime | None = None,
    facts: DataFrame | None = None,
    profile: DataFrame | None = None,
    median: DataFrame | None = None,
) -> DataFrame:
    """Nine key figures as doubles. ``median`` is a frame with that column."""
    facts = facts or whole_table(sales, as_of)
    row = attach(
        _with_duplicates(facts, sales, profile), rank=median or payment_percentiles(sales, median=0.5)
    )
    found = [rule.isNotNull().cast("int") for rule in _issue_rules(facts, expected_rows)]
    figures = {
        "Total records": F.col("total_rows"),
        "Total revenue": F.col("revenue"),
        "Average transaction": average_payment(),
        "Median transaction": F.col("rank.median"),
        "Maximum transaction": F.col("maximum_payment"),
        "Zero-payment records": F.col("zero_payments"),
        "Negative-payment records": F.col("negative_payments"),
        "Missing-payment records": F.col("null_payments"),
        "Business issues identified": reduce(Column.__add__, found),
    }
    return _figures(row, {name: as_double(value) for name, value in figures.items()})


def audit_summary(sales: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row: size, dates, payments and the best product type and channel."""
    best = top_groups(sales).agg(
        *(
            F.max(F.when(F.col("dimension") == name, F.col("top_group"))).alias(f"top_{name}")
            for name in ("product_type", "application_channel")
        )
    )
    row = attach(
        facts or table_facts(sales),
        coverage=dataset_coverage(sales).select("distinct_transactions"),
        rank=payment_percentiles(sales, median=0.5),
        best=best,
    )
    return row.select(
        "total_rows",
        "coverage.distinct_transactions",
        F.col("earliest_transaction").alias("first_transaction"),
        F.col("latest_transaction").alias("last_transaction"),
        total_revenue().alias("total_revenue"),
        average_payment().alias("average_payment"),
        F.col("rank.median").alias("median_payment"),
        as_double(F.col("minimum_payment")).alias("minimum_payment"),
        as_double(F.col("maximum_payment")).alias("maximum_payment"),
        F.col("zero_payments").alias("zero_payment_rows"),
        F.col("negative_payments").alias("negative_payment_rows"),
        F.col("null_payments").alias("null_payment_rows"),
        "best.top_product_type",
        "best.top_application_channel",
    )


# --- flags and scorecard --------------------------------------------------

# Flag findings that do not depend on the data.
DUPLICATES_FINDING = (
    "Repeated identifiers exist. Do not delete records until the dataset grain is established."
)
LOCATION_FINDING = (
    "Fields are stored as text because ticket locations can contain alphanumeric values such as GA1."
)


def _status(good: Column, otherwise: str = "REVIEW") -> Column:
    return F.when(good, "PASS").otherwise(otherwise)


def audit_flags(sales: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Eight flags, in their order. ``facts`` is a kept :func:`whole_table`."""
    facts = facts or whole_table(sales)
    no_ticket = named("null primary_ticket_id") + named("blank primary_ticket_id")

    def flag(area: str, status: Column, finding: Column) -> Column:
        return F.struct(F.lit(area).alias("area"), status.alias("status"), finding.alias("finding"))

    def counted(area: str, count: Column, template: str) -> Column:
        return flag(area, _status(count == 0), _sentence(template, count_text(count)))

    rules = [
        flag("Dataset imported", F.lit("PASS"), _sentence("{} rows available", count_text(F.col("total_rows")))),
        counted("Payment completeness", F.col("null_payments"), "{} NULL payment values"),
        counted("Negative payments", F.col("negative_payments"), "{} negative payment values"),
        counted("Zero payments", F.col("zero_payments"), "{} zero payment values"),
        counted("Primary ticket ID completeness", no_ticket, "{} blank/NULL primary ticket IDs"),
        counted("Hospitality field", named("null is_hospitality"), "{} NULL hospitality values"),
        flag("Duplicate identifiers", F.lit("REVIEW"), F.lit(DUPLICATES_FINDING)),
        flag("Row and seat fields", F.lit("REVIEWED"), F.lit(LOCATION_FINDING)),
    ]
    return lines(facts, rules).orderBy("position").select("area", "status", "finding")


# Scorecard recommendations.
NO_ACTION = "No action required."
ROWS_ADVICE = "Retain the complete dataset as the audit baseline."
ZERO_ADVICE = "Determine whether zero values represent complimentary or non-revenue transactions."
IDENTIFIER_ADVICE = "Determine whether repeated identifiers are expected at the dataset's business grain."


def _checks(expected_rows: int | None) -> list[Column]:
    """The six checks as structs over the facts row."""
    rows = F.col("total_rows")
    complete = F.lit(True) if expected_rows is None else rows == expected_rows

    def check(area: str, status: Column, finding: Column, advice: Column) -> Column:
        values = {"area": F.lit(area), "status": status, "finding": finding, "recommendation": advice}
        return F.struct(*(value.alias(name) for name, value in values.items()))

    def counted(area: str, count: Column, none: str, some: str, advice: str) -> Column:
        good = count == 0
        finding = F.when(good, F.lit(none)).otherwise(_sentence(some, count_text(count)))
        return check(area, _status(good), finding, F.when(good, F.lit(NO_ACTION)).otherwise(F.lit(advice)))

    exact = _sentence("Dataset contains exactly {} rows.", count_text(rows))
    differs = _sentence(
        "Dataset contains {} rows; expected {}.", count_text(rows), count_text(F.lit(expected_rows or 0))
    )
    return [
        check(
            "Dataset completeness",
            _status(complete, "FAIL"),
            F.when(complete, exact).otherwise(differs),
            F.when(complete, F.lit(ROWS_ADVICE)).otherwise(F.lit(ISSUES["rows_differ"][4])),
        ),
        counted(
            "Payment completeness",
            F.col("null_payments"),
            "No NULL total_payment values were detected.",
            "{} NULL total_payment values were detected.",
            ISSUES["null_payments"][4],
        ),
        counted(
            "Negative payments",
            F.col("negative_payments"),
            "No negative payment values were detected.",
            "{} negative payment values were detected.",
            ISSUES["negative_payments"][4],
        ),
        counted(
            "Zero payments",
            F.col("zero_payments"),
            "No zero-payment records were detected.",
            "{} zero-payment records were detected.",
            ZERO_ADVICE,
        ),
        counted(
            "Future transactions",
            F.col("transaction_in_future"),
            "No transaction dates occur after the current timestamp.",
            "{} transaction dates occur after the current timestamp.",
            ISSUES["future_dates"][4],
        ),
        counted(
            "Date ordering",
            F.col("transaction_after_last_touch"),
            "No transaction_date values occur after last_touched_at.",
            "{} transaction_date values occur after last_touched_at.",
            ISSUES["future_dates"][4],
        ),
    ]


def _identifier_checks(sales: DataFrame, profile: DataFrame | None) -> DataFrame:
    groups, name = F.col("repeated_values"), F.col("identifier")
    unique = groups == 0
    profile = profile or identifier_profile(sales, ITEM_IDENTIFIERS)
    return profile.where(name.isin(*ITEM_IDENTIFIERS)).select(
        "position",
        F.concat(F.lit("Identifier: "), name).alias("area"),
        _status(unique).alias("status"),
        F.when(unique, _sentence("No duplicate {} groups were detected.", name))
        .otherwise(_sentence("{} duplicate {} groups were detected.", count_text(groups), name))
        .alias("finding"),
        F.when(unique, F.lit(NO_ACTION)).otherwise(F.lit(IDENTIFIER_ADVICE)).alias("recommendation"),
    )


def quality_scorecard(
    sales: DataFrame,
    as_of: str | datetime,
    expected_rows: int | None = None,
    facts: DataFrame | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Six checks and one line per item identifier.

    Without ``expected_rows`` the row count is taken as complete; a different
    count is the one check that can FAIL.
    """
    table = lines(facts or table_facts(sales, as_of), _checks(expected_rows)).withColumn("part", F.lit(1))
    identifiers = _identifier_checks(sales, profile).withColumn("part", F.lit(2))
    ordered = table.unionByName(identifiers).orderBy("part", "position")
    return ordered.select("area", "status", "finding", "recommendation")


def executive_summary(
    sales: DataFrame,
    as_of: str | datetime,
    expected_rows: int | None = None,
    facts: DataFrame | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Ten lines of text: table figures and the number of checks per status."""
    statuses = ("PASS", "REVIEW", "FAIL")
    identifiers = _identifier_checks(sales, profile).agg(
        *(F.count_if(F.col("status") == status).alias(status) for status in statuses)
    )
    row = attach(facts or table_facts(sales, as_of), identifiers=identifiers)
    checks = [check.getField("status") for check in _checks(expected_rows)]

    def counted(status: str) -> Column:
        return reduce(Column.__add__, ((c == status).cast("int") for c in checks), F.col(f"identifiers.{status}"))

    def money(name: str) -> Column:
        return F.col(name).cast("decimal(28,2)")

    figures = {
        "Total rows": F.col("total_rows"),
        "Earliest transaction": F.date_format("earliest_transaction", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "Latest transaction": F.date_format("latest_transaction", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "Total payment": money("revenue"),
        "Average payment": mean_text(F.col("revenue"), F.col("rows_with_payment"), 4),
        "Minimum payment": money("minimum_payment"),
        "Maximum payment": money("maximum_payment"),
        **{f"{status} checks": counted(status) for status in statuses},
    }
    return _figures(row, {name: value.cast("string") for name, value in figures.items()})
