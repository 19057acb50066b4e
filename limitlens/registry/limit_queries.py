"""Limit monitoring and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens.operators import limits as L, reconcile as R
from limitlens.registry import tables as T


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.limit_status(T.limit_inputs(spark, sf_dir))


def _status_output(status: DataFrame) -> DataFrame:
    kept = status.select(
        F.col("_row_no").alias("row_no"), "base_dt", "desk_cd", "portfolio_id", "risk_factor", "ccy_cd",
        "exposure_amt", "limit_amt", "usage_ratio", "remaining_limit", "status",
    )
    return T.doubles(T.doubles(kept, "exposure_amt", "limit_amt", "remaining_limit"), "usage_ratio", places=10)


_STATUS_OUT = """SELECT row_no, base_dt, desk_cd, trim(portfolio_id) AS portfolio_id, risk_factor, ccy_cd,
  CAST(exposure_amt AS DOUBLE) AS exposure_amt, CAST(limit_amt AS DOUBLE) AS limit_amt,
  round(usage_ratio, 10) AS usage_ratio, CAST(remaining_limit AS DOUBLE) AS remaining_limit, status
FROM status"""


def limit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exposure row of every base date with its state."""
    return _status_output(_status(spark, sf_dir))


def limit_status_base_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one requested base date, given as yyyy-MM-dd."""
    inputs = T.limit_inputs(spark, sf_dir, "1996-01-01", (T.CURRENT,))
    return _status_output(L.limit_status(inputs))


def limit_status_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of positions within a millionth of 90 % and 100 % of their limits."""
    status = L.limit_status(T.edge_inputs(spark, sf_dir)).select(
        "base_dt", "portfolio_id", "risk_factor", "exposure_amt", "remaining_limit", "status"
    )
    return T.doubles(status, "exposure_amt", "remaining_limit")


def limit_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.doubles(
        L.limit_kpis(_status(spark, sf_dir)), "exposure_amt_sum", "limit_amt_sum", "remaining_limit_sum"
    )


_KPI_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}_count"
    for s in ("NORMAL", "WARNING", "BREACH", "NO_LIMIT", "INVALID_LIMIT", "MAPPING_ERROR", "DUPLICATE_LIMIT")
)
_KPIS = f"""kpis AS (SELECT base_dt, count(*) AS total_count, {_KPI_COUNTS},
  CAST(sum(exposure_amt) AS DOUBLE) AS exposure_amt_sum, CAST(sum(limit_amt) AS DOUBLE) AS limit_amt_sum,
  CAST(sum(remaining_limit) AS DOUBLE) AS remaining_limit_sum
FROM status GROUP BY base_dt)"""


def run_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_severity(L.limit_kpis(_status(spark, sf_dir)))


def limit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = T.limit_inputs(spark, sf_dir)
    found = L.limit_findings(inputs, L.limit_kpis(L.limit_status(inputs)))
    return found.select("base_dt", "code", "severity", "severity_rank")


_DATES = """dates AS (SELECT base_dt FROM exposures UNION SELECT base_dt FROM limits)"""

_FINDINGS = f"""SELECT base_dt, code, severity, CAST(severity_rank AS INTEGER) AS severity_rank FROM (
  SELECT d.base_dt, unnest([
    CASE WHEN coalesce(total_count, 0) = 0
      THEN {{'code': 'LIMIT_MONITOR_NO_ROWS', 'severity': 'Low', 'severity_rank': 1}}
      ELSE {{'code': 'LIMIT_MONITOR_COMPLETE', 'severity': 'Info', 'severity_rank': 0}} END,
    CASE WHEN breach_count > 0 THEN {{'code': 'LIMIT_BREACH_DETECTED', 'severity': 'High', 'severity_rank': 3}} END,
    CASE WHEN no_limit_count > 0 THEN {{'code': 'LIMIT_NO_LIMIT_DETECTED', 'severity': 'Medium', 'severity_rank': 2}} END,
    CASE WHEN invalid_limit_count > 0 THEN {{'code': 'LIMIT_INVALID_LIMIT_DETECTED', 'severity': 'Medium', 'severity_rank': 2}} END,
    CASE WHEN mapping_error_count > 0 THEN {{'code': 'LIMIT_MAPPING_ERROR', 'severity': 'High', 'severity_rank': 3}} END,
    CASE WHEN duplicate_limit_count > 0 THEN {{'code': 'LIMIT_DUPLICATE_LIMIT_DETECTED', 'severity': 'Medium', 'severity_rank': 2}} END
  ], recursive := true) FROM dates d LEFT JOIN kpis USING (base_dt)) WHERE code IS NOT NULL"""


def _recon(spark: SparkSession, sf_dir: str):
    inputs = T.limit_inputs(spark, sf_dir)
    status = L.limit_status(inputs)
    return inputs, status, R.recon_exceptions(inputs, status)


def recon_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exception, identical ones counted."""
    _, _, found = _recon(spark, sf_dir)
    return found.groupBy("base_dt", "code", "severity", "portfolio_id", "risk_factor").agg(
        F.sum("n").alias("n")
    )


def recon_exception_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per exception."""
    from limitlens.plans.expand import expand_counts

    _, _, found = _recon(spark, sf_dir)
    return expand_counts(found).select("base_dt", "code", "severity", "portfolio_id", "risk_factor")


def recon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, _, found = _recon(spark, sf_dir)
    return R.recon_summary(inputs, found)


def recon_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, _, found = _recon(spark, sf_dir)
    return R.recon_result(R.recon_summary(inputs, found))


def join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = T.limit_inputs(spark, sf_dir)
    return R.join_audit(inputs, L.limit_status(inputs)).drop("requested", "valid")


def orphan_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit keys without an exposure on their date."""
    inputs = T.limit_inputs(spark, sf_dir)
    return L.limit_lookup(inputs).select(*L.KEYS).join(
        inputs.exposures.select(*L.KEYS).distinct(), list(L.KEYS), "left_anti"
    )


EXCEPTIONS_SQL = f"""{_DATES},
src AS (SELECT base_dt, count(*) AS n, sum(exposure_amt) AS amt, count(*) FILTER (WHERE exposure_amt IS NULL) AS bad
        FROM exposures GROUP BY base_dt),
st AS (SELECT base_dt, count(*) AS n, sum(exposure_amt) AS amt,
        sum(greatest(1, limit_rows)) AS potential FROM status GROUP BY base_dt),
lim AS (SELECT base_dt, count(*) AS n FROM limits GROUP BY base_dt),
firstlim AS (SELECT base_dt, pf_key, rf_key, count(*) AS n,
        count(*) FILTER (WHERE limit_amt IS NULL OR limit_amt <= 0) AS nonpositive FROM limits GROUP BY ALL),
exc AS (
  SELECT base_dt, status AS code, CASE status WHEN 'MAPPING_ERROR' THEN 'High' ELSE 'Medium' END AS severity,
    trim(portfolio_id) AS portfolio_id, risk_factor, 1 AS n
  FROM status WHERE status IN ('NO_LIMIT','INVALID_LIMIT','DUPLICATE_LIMIT','MAPPING_ERROR')
  UNION ALL SELECT base_dt, 'RECON_EXPOSURE_NO_LIMIT', 'Medium', trim(portfolio_id), risk_factor, 1
  FROM status WHERE status = 'NO_LIMIT'
  UNION ALL SELECT base_dt, 'RECON_LIMIT_NO_EXPOSURE', 'Low', pf_key, rf_key, 1
  FROM firstlim f WHERE NOT EXISTS (SELECT 1 FROM exposures e
    WHERE e.base_dt = f.base_dt AND e.pf_key = f.pf_key AND e.rf_key = f.rf_key)
  UNION ALL SELECT base_dt, 'RECON_DUPLICATE_LIMIT', 'Medium', pf_key, rf_key, 1 FROM firstlim WHERE n > 1
  UNION ALL SELECT base_dt, 'RECON_NONPOSITIVE_LIMIT', 'Medium', pf_key, rf_key, nonpositive
  FROM firstlim WHERE nonpositive > 0
  UNION ALL SELECT d.base_dt, 'RECON_BASEDATE_MISMATCH', 'Low', '', '', 1
  FROM dates d ANTI JOIN src USING (base_dt)
  UNION ALL SELECT d.base_dt, 'RECON_BASEDATE_MISMATCH', 'Low', '', '', 1
  FROM dates d ANTI JOIN lim USING (base_dt)
  UNION ALL SELECT e.base_dt, 'RECON_CURRENCY_MISMATCH', 'Medium', trim(e.portfolio_id), e.risk_factor, 1
  FROM exposures e JOIN (SELECT DISTINCT base_dt, pf_key, rf_key, upper(ccy_cd) AS c FROM limits) l
    USING (base_dt, pf_key, rf_key) WHERE e.ccy_cd <> '' AND upper(e.ccy_cd) <> l.c
  UNION ALL SELECT e.base_dt, 'RECON_UNIT_MISMATCH', 'Medium', trim(e.portfolio_id), e.risk_factor, 1
  FROM exposures e JOIN (SELECT DISTINCT base_dt, pf_key, rf_key, upper(unit_cd) AS c FROM limits) l
    USING (base_dt, pf_key, rf_key) WHERE e.unit_cd <> '' AND upper(e.unit_cd) <> l.c
  UNION ALL SELECT d.base_dt, 'RECON_ROW_AMPLIFICATION', 'High', '', '', 1
  FROM dates d LEFT JOIN src USING (base_dt) LEFT JOIN st USING (base_dt)
  WHERE greatest(coalesce(st.n, 0), coalesce(st.potential, 0)) > coalesce(src.n, 0)
  UNION ALL SELECT d.base_dt, 'RECON_SUM_BALANCE', 'High', '', '', 1
  FROM dates d LEFT JOIN src USING (base_dt) LEFT JOIN st USING (base_dt)
  WHERE coalesce(src.amt, 0) <> coalesce(st.amt, 0) OR coalesce(src.bad, 0) > 0),
codes AS (SELECT * FROM (VALUES
  (1, 'RECON_EXPOSURE_NO_LIMIT'), (2, 'RECON_LIMIT_NO_EXPOSURE'), (3, 'RECON_DUPLICATE_LIMIT'),
  (4, 'RECON_BASEDATE_MISMATCH'), (5, 'RECON_CURRENCY_MISMATCH'), (6, 'RECON_UNIT_MISMATCH'),
  (7, 'RECON_NONPOSITIVE_LIMIT'), (8, 'RECON_ROW_AMPLIFICATION'), (9, 'RECON_SUM_BALANCE')) v(check_order, code)),
summary AS (
  SELECT d.base_dt, c.check_order, c.code, TRUE AS applicable, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS exception_count,
    coalesce(arg_max(e.severity, CASE e.severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END), 'Info') AS max_severity
  FROM dates d CROSS JOIN codes c LEFT JOIN exc e ON e.base_dt = d.base_dt AND e.code = c.code
  GROUP BY ALL)"""

QUERIES = {
    "limit_status": limit_status,
    "limit_status_base_date": limit_status_base_date,
    "limit_status_edges": limit_status_edges,
    "limit_kpis": limit_kpis,
    "run_severity": run_severity,
    "limit_findings": limit_findings,
    "recon_exceptions": recon_exceptions,
    "recon_exception_rows": recon_exception_rows,
    "recon_summary": recon_summary,
    "recon_result": recon_result,
    "join_audit": join_audit,
    "orphan_limits": orphan_limits,
}

SQL = {
    "limit_status": f"WITH {T.STATUS_SQL} {_STATUS_OUT}",
    "limit_status_base_date": f"WITH {T.STATUS_SQL} {_STATUS_OUT} WHERE base_dt = '19960101'",
    "limit_status_edges": f"""WITH {T.EDGES_SQL} SELECT base_dt, portfolio_id, risk_factor,
      CAST(e AS DOUBLE) AS exposure_amt, status,
      CASE WHEN status IN ('NORMAL','WARNING','BREACH') THEN CAST(l - abs(e) AS DOUBLE) ELSE 0 END AS remaining_limit
      FROM edge_status""",
    "limit_kpis": f"WITH {T.STATUS_SQL}, {_KPIS} SELECT * FROM kpis",
    "run_severity": f"""WITH {T.STATUS_SQL}, {_KPIS} SELECT base_dt,
      CASE WHEN breach_count + mapping_error_count > 0 THEN 'High'
           WHEN warning_count + no_limit_count + invalid_limit_count + duplicate_limit_count > 0 THEN 'Medium'
           ELSE 'Info' END AS severity FROM kpis""",
    "limit_findings": f"WITH {T.STATUS_SQL}, {_KPIS}, {_DATES} {_FINDINGS}",
    "recon_exceptions": f"""WITH {T.STATUS_SQL}, {EXCEPTIONS_SQL}
      SELECT base_dt, code, severity, portfolio_id, risk_factor, CAST(sum(n) AS BIGINT) AS n FROM exc GROUP BY ALL""",
    "recon_exception_rows": f"""WITH {T.STATUS_SQL}, {EXCEPTIONS_SQL}
      SELECT base_dt, code, severity, portfolio_id, risk_factor FROM exc, range(n)""",
    "recon_summary": f"WITH {T.STATUS_SQL}, {EXCEPTIONS_SQL} SELECT * FROM summary",
    "recon_result": f"""WITH {T.STATUS_SQL}, {EXCEPTIONS_SQL}
      SELECT base_dt, count(*) AS check_count, CAST(sum(exception_count) AS BIGINT) AS recon_exceptions,
        CASE WHEN sum(exception_count) FILTER (WHERE code IN
          ('RECON_NONPOSITIVE_LIMIT','RECON_ROW_AMPLIFICATION','RECON_SUM_BALANCE')) = 0
          THEN 'PASS' ELSE 'FAIL' END AS state FROM summary GROUP BY base_dt""",
    "join_audit": f"""WITH {T.STATUS_SQL}, {_DATES},
      dup AS (SELECT base_dt, count(*) AS duplicate_keys, CAST(sum(n) AS BIGINT) AS duplicate_rows FROM (
        SELECT base_dt, count(*) AS n FROM limits GROUP BY base_dt, pf_key, rf_key HAVING count(*) > 1) GROUP BY base_dt),
      blk AS (SELECT base_dt, count(*) AS blocked_rows FROM status WHERE status = 'DUPLICATE_LIMIT' GROUP BY base_dt)
      SELECT base_dt, coalesce(duplicate_keys, 0) AS duplicate_keys, coalesce(duplicate_rows, 0) AS duplicate_rows,
        coalesce(blocked_rows, 0) AS blocked_rows, TRUE AS currency_applicable, TRUE AS unit_applicable
      FROM dates LEFT JOIN dup USING (base_dt) LEFT JOIN blk USING (base_dt)""",
    "orphan_limits": f"""WITH {T.EXPOSURES_SQL},{T.LIMITS_SQL} SELECT DISTINCT base_dt, pf_key, rf_key FROM limits l
      WHERE NOT EXISTS (SELECT 1 FROM exposures e WHERE e.base_dt = l.base_dt AND e.pf_key = l.pf_key AND e.rf_key = l.rf_key)""",
}
