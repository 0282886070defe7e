"""Fixed report parameters used by the registered plans (fixture windows)."""

SALES_START = "2001-01-01"
SALES_END = "2001-06-30"
STOCK_BASE = "2001-01-01"
STOCK_START = "2001-03-01"
STOCK_END = "2001-03-31"
SNAPSHOT_DAY = "2001-03-15"
AS_OF = "2001-06-30"
EVENTS_START = "2024-01-01"
EVENTS_END = "2024-01-30"

# SQL spellings of the rules, for the oracle text.
EFF_SQL = "status NOT ILIKE 'C%' AND status NOT ILIKE 'R%'"
SALES_WHERE = f"order_date BETWEEN DATE '{SALES_START}' AND DATE '{SALES_END}' AND {EFF_SQL}"


def money_sum_sql(expr: str) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,2))) AS DOUBLE)"


def js_round_sql(expr: str) -> str:
    return f"CAST(floor(({expr}) + 0.5) AS BIGINT)"



def js_rate_sql(num: str, den: str) -> str:
    return f"CAST(floor(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 1000.0 + 0.5) / 10.0 AS DOUBLE)"
