"""Account filter shared by all categories."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fiscus.functions.predicates import contains_any, starts_with_any
from fiscus.schema import ACCOUNT

# Accounts that carry revenue. The first is searched anywhere in
# the code, the others only at its start.
BUDGET_ACCOUNT_PART = "521"
COLLECTION_ACCOUNTS = ("62121", "62131", "62132")


REVENUE_ACCOUNT = (
    f"({contains_any(ACCOUNT, [BUDGET_ACCOUNT_PART])} OR {starts_with_any(ACCOUNT, COLLECTION_ACCOUNTS)})"
)


def revenue_accounts(fact: DataFrame) -> DataFrame:
    return fact.filter(REVENUE_ACCOUNT)
