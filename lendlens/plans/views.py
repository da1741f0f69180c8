"""The query inputs as SQL views for the checking engine."""

from __future__ import annotations

import re

from lendlens.constants import ORDINAL_LEVELS, SCALED_FEATURES
from lendlens.functions.numeric import NUMBER_PATTERN
from lendlens.sources import fixtures as fx

STAMP = f"o_orderdate + to_hours(CAST({fx.K} % 24 AS INTEGER))"
NUMBER = NUMBER_PATTERN.replace("\\", "\\")


def _select(columns: dict[str, str | None], stamps: dict[str, str]) -> str:
    return ", ".join(f"{sql or stamps[name]} AS {name}" for name, sql in columns.items())


def parsed(column: str) -> str:
    return (f"CASE WHEN regexp_full_match({column}, '{NUMBER}') "
            f"THEN TRY_CAST(trim({column}) AS DOUBLE) END")


def code(column: str) -> str:
    levels = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(ORDINAL_LEVELS[column]))
    return f"CAST(CASE {column} {levels} ELSE -1 END AS DOUBLE)"


TIME_PARTS = {
    "transaction_hour": "CAST(hour(transaction_timestamp) AS INTEGER)",
    "transaction_day_of_week": "CAST(isodow(transaction_timestamp) - 1 AS INTEGER)",
    "transaction_month": "CAST(month(transaction_timestamp) AS INTEGER)",
    "transaction_day_of_month": "CAST(day(transaction_timestamp) AS INTEGER)",
    "week_of_month": "CAST((day(transaction_timestamp) - 1) // 7 + 1 AS INTEGER)",
    "is_weekend": "CAST(isodow(transaction_timestamp) IN (6, 7) AS INTEGER)",
    "is_month_end": "CAST(day(transaction_timestamp) >= 25 AS INTEGER)",
    "is_holiday_season": "CAST(month(transaction_timestamp) IN (11, 12) AS INTEGER)",
    "is_business_hours": "CAST(hour(transaction_timestamp) BETWEEN 9 AND 17 AS INTEGER)",
    "is_late_night": "CAST(hour(transaction_timestamp) >= 22 OR hour(transaction_timestamp) <= 5 AS INTEGER)",
    "time_of_day":
        "CASE WHEN hour(transaction_timestamp) <= 6 THEN 'night' "
        "WHEN hour(transaction_timestamp) <= 12 THEN 'morning' "
        "WHEN hour(transaction_timestamp) <= 18 THEN 'afternoon' ELSE 'evening' END",
}

DUMMY_COLUMNS = {f"{c}_{v}": (c, v) for c, vs in fx.DUMMIES.items() for v in vs}

CODES = {f"{c}_encoded": code(c) for c in ORDINAL_LEVELS}

DECISION = "CASE WHEN risk_level IN ('high', 'very_high') THEN 'decline' ELSE 'approve' END"

MODEL_INPUT = [f for f in fx.MODEL_FEATURES if f not in SCALED_FEATURES]


def _r_view() -> str:
    parts = ", ".join(f"{sql} AS {name}" for name, sql in TIME_PARTS.items())
    dummies = ", ".join(f"CAST({c} = '{v}' AS DOUBLE) AS \"{n}\"" for n, (c, v) in DUMMY_COLUMNS.items())
    codes = ", ".join(f"{sql} AS {n}" for n, sql in CODES.items())
    return (f"SELECT *, {dummies} FROM (SELECT *, {parts}, {codes} FROM T)")


def _e_view() -> str:
    kept = ["customer_tenure_days", "risk_score", "installment_count", "payment_credit_limit",
            "week_of_month", "is_weekend", "is_month_end", "is_holiday_season", "is_business_hours",
            "is_late_night", *CODES, *DUMMY_COLUMNS]
    columns = ", ".join(f'"{c}"' for c in kept)
    common = parsed(
        "coalesce(price_comparison_time, (SELECT price_comparison_time FROM T "
        "WHERE price_comparison_time IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))")
    return (
        "SELECT transaction_id, amount, CAST(will_default AS INTEGER) AS will_default, "
        "coalesce(CAST(days_to_first_missed_payment AS DOUBLE), "
        "(SELECT quantile_cont(days_to_first_missed_payment, 0.5) FROM T)) AS days_to_first_missed_payment, "
        f"CAST(device_is_trusted AS INTEGER) AS device_is_trusted, {common} AS price_comparison_time, "
        f"{columns} FROM R")


def _x_view() -> str:
    price = (f"coalesce({parsed('price_comparison_time')}, (SELECT quantile_cont(v, 0.5) FROM "
             f"(SELECT {parsed('price_comparison_time')} AS v FROM T)))")
    cells = {"price_comparison_time": price}
    columns = ", ".join(f'CAST({cells.get(f, chr(34) + f + chr(34))} AS DOUBLE) AS "{f}"'
                        for f in fx.MODEL_FEATURES)
    return f"SELECT transaction_id, CAST(will_default AS INTEGER) AS will_default, {columns} FROM R"


def feature_structs(expression: str, source: str = "X", extra: str = "") -> str:
    """One row per feature from a single scan; ``{f}`` in the expression is the column."""
    cells = ", ".join(
        "{'feature': '%s', %s}" % (f, expression.replace("{f}", f'"{f}"')) for f in fx.MODEL_FEATURES)
    return f"SELECT unnest([{cells}], recursive := true) FROM {source} {extra}"


def linear_margin(model: str, scale: dict[str, str] | None = None) -> str:
    terms = []
    for _, name, _, _, feature, value in fx.coefficient_rows():
        if name == model and feature == fx.INTERCEPT:
            terms.append(f"CAST({value!r} AS DOUBLE)")
        elif name == model and value:
            terms.append(f"CAST({value!r} AS DOUBLE) * {(scale or {}).get(feature, chr(34) + feature + chr(34))}")
    return " + ".join(terms)


def _split_view(source: str, sort: str = "transaction_id") -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY will_default ORDER BY "
            f"md5(concat({sort}, '42')), {sort}) AS rn, count(*) OVER (PARTITION BY will_default) AS cnt FROM {source}")


M_CASES = " UNION ALL ".join(
    f"SELECT '{m}' AS model_name, feature, "
    f"round(sign(r) * greatest(abs(r) - {cut}, 0) / {by}, 9) AS coefficient FROM MR"
    for m, (cut, by) in fx.MARGINAL_MODELS.items())

VIEWS: dict[str, str] = {
    "T": ("SELECT " + _select(fx.TRANSACTIONS, {"transaction_timestamp": STAMP})
          + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "P": ("SELECT " + _select(fx.PAYMENTS, {
        "transaction_date": STAMP, "payment_date": "l_shipdate",
        "payment_due_date": "o_orderdate + INTERVAL 30 DAY"})
        + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"),
    "S": ("SELECT model_name, transaction_id, CAST(will_default AS INTEGER) AS label, "
          "round(CAST(a*((transaction_id*37)%101) + b*((transaction_id*71)%97) AS DOUBLE)/10000, 6) AS score "
          "FROM T CROSS JOIN (VALUES "
          + ", ".join(f"('{m}', {a}, {b})" for m, a, b in fx.SCORE_MODELS) + ") AS v(model_name, a, b)"),
    "R": _r_view(),
    "E": _e_view(),
    "X": _x_view(),
    "XS": _split_view("X"),
    "TS": _split_view("T"),
    "MR": feature_structs("'r': coalesce(corr({f}, will_default), 0)"),
    "M": M_CASES,
    # Scores collapsed per model and value, with running counts from the top and the bottom.
    "N": "SELECT model_name, score, count(*) AS n, sum(label) AS pos FROM S GROUP BY 1, 2",
    "Q": ("SELECT model_name, score, n, pos, "
          "sum(n) OVER w AS above, sum(pos) OVER w AS tp, "
          "sum(n) OVER (PARTITION BY model_name) AS size, "
          "sum(pos) OVER (PARTITION BY model_name) AS positives, "
          "CAST(sum(pos) OVER w AS DOUBLE) / sum(n) OVER w AS prec, "
          "CAST(sum(pos) OVER w AS DOUBLE) / sum(pos) OVER (PARTITION BY model_name) AS rec "
          "FROM N WINDOW w AS (PARTITION BY model_name ORDER BY score DESC)"),
    "AUC": ("SELECT model_name, sum((n - pos) * (tp - pos + pos / 2.0)) / "
            "(CAST(max(positives) AS DOUBLE) * (max(size) - max(positives))) AS auc FROM Q GROUP BY 1"),
    "EDGES": ("SELECT model_name, quantile_cont(score, 1/3.0) AS q1, quantile_cont(score, 2/3.0) AS q2, "
              "quantile_cont(score, 0.9) AS p90, min(score) AS lo, max(score) AS hi FROM S GROUP BY 1"),
    "SEG": ("SELECT S.*, CASE WHEN score <= q1 THEN 'Low' WHEN score <= q2 THEN 'Medium' ELSE 'High' END "
            "AS segment, score >= p90 AS top FROM S JOIN EDGES USING (model_name)"),
    "THIRDS": ("SELECT model_name, round_even(avg(label) FILTER (segment = 'High'), 3) AS high_rate, "
               "round_even(avg(label) FILTER (segment = 'Low'), 3) AS low_rate FROM SEG GROUP BY 1"),
    "DECILE": ("SELECT model_name, avg(label) FILTER (top) AS top10_precision, "
               "avg(label) FILTER (NOT top) AS bottom90_rate, "
               "avg(label) FILTER (top) / avg(label) FILTER (NOT top) AS discrimination_top10 "
               "FROM SEG GROUP BY 1"),
}


def needed(body: str) -> list[str]:
    """Views a query uses, directly or through other views, in order of definition."""
    used: set[str] = set()

    def visit(sql: str) -> None:
        for name, view in VIEWS.items():
            if name not in used and re.search(rf"\b{name}\b", sql):
                used.add(name)
                visit(view)

    visit(body)
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in VIEWS:
            if other != name and other in used and re.search(rf"\b{other}\b", VIEWS[name]):
                place(other)
        order.append(name)

    for name in VIEWS:
        if name in used:
            place(name)
    return order
