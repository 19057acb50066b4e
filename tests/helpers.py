"""Small tables and row access for tests."""

from __future__ import annotations

from limitlens.operators import limits as L, reconcile as R
from limitlens.sources.mapping import ColumnMapping

EXPOSURE = ["BASE_DT", "DESK_CD", "PORTFOLIO_ID", "PRODUCT_TYPE", "RISK_FACTOR", "CCY_CD", "EXPOSURE_AMT"]
LIMIT = ["BASE_DT", "PORTFOLIO_ID", "RISK_FACTOR", "LIMIT_AMT", "USE_YN"]
DAY = "20260617"


def table(spark, columns, rows):
    numbered = [(*map(str, row), i) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, ", ".join(f"{c} string" for c in columns) + ", ROW_NO long")


def exposures(spark, rows):
    """Rows of (portfolio, factor, amount) or (portfolio, factor, amount, date)."""
    full = [
        (r[3] if len(r) > 3 else DAY, "EQD", r[0], "ELS", r[1], "KRW", r[2]) for r in rows
    ]
    return table(spark, EXPOSURE, full)


def limits(spark, rows):
    """Rows of (portfolio, factor, amount[, use_yn[, date]])."""
    full = [
        (r[4] if len(r) > 4 else DAY, r[0], r[1], r[2], r[3] if len(r) > 3 else "Y") for r in rows
    ]
    return table(spark, LIMIT, full)


class Run:
    """One bound analysis with collected results."""

    def __init__(self, exposure, limit, base_dts=DAY, mapping=None):
        self.inputs = L.bind(exposure, limit, base_dts, mapping or ColumnMapping(), row_no="ROW_NO")
        self.status = L.limit_status(self.inputs)
        self.exceptions = R.recon_exceptions(self.inputs, self.status)
        self.summary_df = R.recon_summary(self.inputs, self.exceptions)

    def states(self):
        return {r["portfolio_id"]: r["status"] for r in self.status.collect()}

    def kpis(self):
        return L.limit_kpis(self.status).collect()

    def summary(self):
        return {r["code"]: r for r in self.summary_df.collect()}

    def counts(self):
        return {code: r["exception_count"] for code, r in self.summary().items()}

    def result(self):
        return R.recon_result(self.summary_df).first()["state"]

    def codes(self):
        found: dict[str, int] = {}
        for r in self.exceptions.collect():
            found[r["code"]] = found.get(r["code"], 0) + r["n"]
        return found
