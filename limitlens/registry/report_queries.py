"""Chart aggregates, date comparison and SQL reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens.operators import limits as L, priorday as P, templates as M, visual as V
from limitlens.registry import tables as T


def month_pairs(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """Neighbouring months, from that of the first order to that of the last."""
    span = T.table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).first()
    first, last = (d.year * 12 + d.month - 1 for d in (span["a"], span["b"]))
    months = [f"{m // 12}{m % 12 + 1:02d}01" for m in range(first, last + 1)]
    return list(zip(months[1:], months[:-1]))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.limit_status(T.limit_inputs(spark, sf_dir))


def status_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.doubles(V.status_mix(_status(spark, sf_dir)), "ratio")


def top_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = V.top_exposures(_status(spark, sf_dir))
    return T.doubles(T.doubles(top, "exposure_amt", "abs_exposure"), "usage_ratio", places=10)


def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.doubles(
        V.concentration(_status(spark, sf_dir)), "total_abs_exposure", "top_abs_exposure", "top_share", "hhi"
    )


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.heatmap(_status(spark, sf_dir)).withColumnRenamed("_row_no", "row_no")
    return T.doubles(rows, "usage_ratio", places=10)


def visual_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.visual_findings(_status(spark, sf_dir)).select("base_dt", "code", "severity", "message")


def currency_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.currency_codes(_status(spark, sf_dir)).select("base_dt", "ccy", "n")


_DELTAS = ("usage_ratio", "exposure_amt", "limit_amt", "remaining_limit")


def prior_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbouring months compared in one job."""
    compared = P.prior_day(_status(spark, sf_dir), month_pairs(spark, sf_dir))
    for m in _DELTAS:
        places = 9 if m == "usage_ratio" else None
        compared = T.doubles(compared, f"current_{m}", f"prior_{m}", f"{m}_delta", places=places)
    return compared


def prior_day_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prior_day_kpis(P.prior_day(_status(spark, sf_dir), month_pairs(spark, sf_dir)))


def prior_day_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    movers = P.prior_day_movers(P.prior_day(_status(spark, sf_dir), month_pairs(spark, sf_dir)))
    return T.doubles(
        movers.select("current_dt", "prior_dt", "rank", "portfolio_id", "risk_factor",
                      "usage_ratio_delta", "movement"),
        "usage_ratio_delta", places=9,
    )


def prior_day_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.duplicate_keys(_status(spark, sf_dir), month_pairs(spark, sf_dir))


def prior_day_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _status(spark, sf_dir)
    pairs = month_pairs(spark, sf_dir)
    found = P.prior_day_findings(status, P.prior_day(status, pairs), pairs)
    return found.groupBy("current_dt", "prior_dt", "code", "severity").agg(F.count("*").alias("findings"))


_VISUAL = {
    "status_mix": """SELECT base_dt, v.status_order, v.status, count(*) FILTER (WHERE s.status = v.status) AS row_count,
      round(count(*) FILTER (WHERE s.status = v.status) / count(*), 4) AS ratio
      FROM status s CROSS JOIN (VALUES (1, 'NORMAL'), (2, 'WARNING'), (3, 'BREACH'), (4, 'NO_LIMIT'),
        (5, 'INVALID_LIMIT'), (6, 'MAPPING_ERROR'), (7, 'DUPLICATE_LIMIT')) v(status_order, status)
      GROUP BY base_dt, v.status_order, v.status""",
    "top_exposures": """SELECT base_dt, trim(portfolio_id) AS portfolio_id, risk_factor, ccy_cd,
      CAST(exposure_amt AS DOUBLE) AS exposure_amt, CAST(abs(exposure_amt) AS DOUBLE) AS abs_exposure,
      round(usage_ratio, 10) AS usage_ratio, status, rank
      FROM (SELECT *, row_number() OVER (PARTITION BY base_dt
        ORDER BY abs(exposure_amt) DESC, trim(portfolio_id), risk_factor, row_no) AS rank FROM status) WHERE rank <= 10""",
    "concentration": """SELECT base_dt, CAST(sum(a) AS DOUBLE) AS total_abs_exposure,
      CAST(sum(a) FILTER (WHERE rank <= 10) AS DOUBLE) AS top_abs_exposure,
      CASE WHEN sum(a) = 0 THEN 0 ELSE round(CAST(sum(a) FILTER (WHERE rank <= 10) AS DOUBLE) / CAST(sum(a) AS DOUBLE), 4) END AS top_share,
      CASE WHEN sum(a) = 0 THEN 0 ELSE round(sum(CAST(a AS DOUBLE) * CAST(a AS DOUBLE)) / pow(CAST(sum(a) AS DOUBLE), 2), 6) END AS hhi,
      count(*) AS row_count, count(*) FILTER (WHERE rank <= 10) AS top_count
      FROM (SELECT base_dt, abs(exposure_amt) AS a,
        row_number() OVER (PARTITION BY base_dt ORDER BY abs(exposure_amt) DESC) AS rank FROM status) GROUP BY base_dt""",
    "heatmap": """SELECT row_no, base_dt, trim(portfolio_id) AS portfolio_id, risk_factor, round(usage_ratio, 10) AS usage_ratio,
      CASE WHEN usage_ratio < 0.8 THEN 'LOW' WHEN usage_ratio <= 1 THEN 'MID' ELSE 'HIGH' END AS grade, status FROM status""",
    "visual_findings": """SELECT base_dt, 'MIXED_CURRENCY' AS code, 'Medium' AS severity,
      string_agg(DISTINCT upper(ccy_cd), '/' ORDER BY upper(ccy_cd)) AS message
      FROM status WHERE ccy_cd <> '' GROUP BY base_dt HAVING count(DISTINCT upper(ccy_cd)) > 1
      UNION ALL SELECT base_dt, 'VISUAL_CONCENTRATION_ZERO_DENOMINATOR', 'Low', 'all exposures are zero'
      FROM status GROUP BY base_dt HAVING sum(abs(exposure_amt)) = 0""",
    "currency_codes": """SELECT base_dt, upper(ccy_cd) AS ccy, count(*) AS n FROM status WHERE ccy_cd <> ''
      AND base_dt IN (SELECT base_dt FROM status WHERE ccy_cd <> '' GROUP BY base_dt HAVING count(DISTINCT upper(ccy_cd)) > 1)
      GROUP BY base_dt, upper(ccy_cd)""",
}

_PAIRED = """
months AS (SELECT strftime(d, '%Y%m%d') AS prior_dt, strftime(d + INTERVAL 1 MONTH, '%Y%m%d') AS current_dt
  FROM (SELECT unnest(range(CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP),
    CAST(date_trunc('month', max(o_orderdate)) AS TIMESTAMP), INTERVAL 1 MONTH)) AS d FROM orders)),
rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base_dt, pf_key, rf_key
    ORDER BY trim(portfolio_id), risk_factor, status, row_no) AS rn FROM status) WHERE rn = 1),
cur AS (SELECT m.current_dt, m.prior_dt, r.* FROM rep r JOIN months m ON r.base_dt = m.current_dt),
pri AS (SELECT m.current_dt, m.prior_dt, r.* FROM rep r JOIN months m ON r.base_dt = m.prior_dt),
cmp AS (SELECT current_dt, prior_dt, trim(coalesce(c.portfolio_id, p.portfolio_id)) AS portfolio_id,
    coalesce(c.risk_factor, p.risk_factor) AS risk_factor, c.status AS current_status, p.status AS prior_status,
    coalesce(c.usage_ratio, 0) AS cu, coalesce(p.usage_ratio, 0) AS pu,
    coalesce(c.exposure_amt, 0) AS ce, coalesce(p.exposure_amt, 0) AS pe,
    coalesce(c.limit_amt, 0) AS cl, coalesce(p.limit_amt, 0) AS pl,
    coalesce(c.remaining_limit, 0) AS cr, coalesce(p.remaining_limit, 0) AS pr
  FROM cur c FULL JOIN pri p USING (current_dt, prior_dt, pf_key, rf_key)),
compared AS (SELECT *, CASE WHEN current_status IS NULL THEN 'Resolved' WHEN prior_status IS NULL THEN 'New'
    WHEN current_status NOT IN ('NORMAL','WARNING','BREACH') OR current_status <> prior_status THEN 'StateTransition'
    WHEN cu > pu THEN 'Increased' WHEN cu < pu THEN 'Decreased' ELSE 'Unchanged' END AS movement FROM cmp),
dupkeys AS (SELECT current_dt, prior_dt, side, base_dt, min(trim(portfolio_id)) AS portfolio_id,
    arg_min(risk_factor, [trim(portfolio_id), risk_factor]) AS risk_factor, count(*) AS row_count
  FROM (SELECT m.*, 'Current' AS side, s.* FROM status s JOIN months m ON s.base_dt = m.current_dt
        UNION ALL SELECT m.*, 'Prior', s.* FROM status s JOIN months m ON s.base_dt = m.prior_dt)
  GROUP BY current_dt, prior_dt, side, base_dt, pf_key, rf_key HAVING count(*) > 1)"""

_PRIOR = {
    "prior_day": """SELECT current_dt, prior_dt, portfolio_id, risk_factor, current_status, prior_status,
      round(cu, 9) AS current_usage_ratio, round(pu, 9) AS prior_usage_ratio, round(cu - pu, 9) AS usage_ratio_delta,
      CAST(ce AS DOUBLE) AS current_exposure_amt, CAST(pe AS DOUBLE) AS prior_exposure_amt, CAST(ce - pe AS DOUBLE) AS exposure_amt_delta,
      CAST(cl AS DOUBLE) AS current_limit_amt, CAST(pl AS DOUBLE) AS prior_limit_amt, CAST(cl - pl AS DOUBLE) AS limit_amt_delta,
      CAST(cr AS DOUBLE) AS current_remaining_limit, CAST(pr AS DOUBLE) AS prior_remaining_limit,
      CAST(cr - pr AS DOUBLE) AS remaining_limit_delta, movement FROM compared""",
    "prior_day_kpis": """SELECT current_dt, prior_dt, count(*) AS compared_count,
      count(*) FILTER (WHERE movement = 'New') AS new_count, count(*) FILTER (WHERE movement = 'Resolved') AS resolved_count,
      count(*) FILTER (WHERE movement = 'StateTransition') AS statetransition_count,
      count(*) FILTER (WHERE movement = 'Increased') AS increased_count,
      count(*) FILTER (WHERE movement = 'Decreased') AS decreased_count,
      count(*) FILTER (WHERE movement = 'Unchanged') AS unchanged_count FROM compared GROUP BY ALL""",
    "prior_day_movers": """SELECT current_dt, prior_dt, rank, portfolio_id, risk_factor,
      round(cu - pu, 9) AS usage_ratio_delta, movement FROM (
      SELECT *, row_number() OVER (PARTITION BY current_dt, prior_dt ORDER BY abs(cu - pu) DESC, portfolio_id, risk_factor) AS rank
      FROM compared WHERE movement IN ('Increased','Decreased','Unchanged')) WHERE rank <= 10""",
    "prior_day_duplicate_keys": "SELECT * FROM dupkeys",
    "prior_day_findings": """SELECT current_dt, prior_dt, code, severity, count(*) AS findings FROM (
      SELECT current_dt, prior_dt, 'PRIOR_DAY_STATE_TRANSITION' AS code, 'Medium' AS severity
      FROM compared WHERE movement = 'StateTransition'
      UNION ALL SELECT current_dt, prior_dt, 'PRIOR_DAY_DUPLICATE_KEY', 'Medium' FROM dupkeys
      UNION ALL SELECT current_dt, prior_dt, 'BASE_DT_FORMAT_MISMATCH', 'Low' FROM months m
      WHERE current_dt NOT IN (SELECT base_dt FROM status)
      UNION ALL SELECT current_dt, prior_dt, 'BASE_DT_FORMAT_MISMATCH', 'Low' FROM months m
      WHERE prior_dt NOT IN (SELECT base_dt FROM status)) GROUP BY ALL""",
}


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return M.prepared(T.limit_inputs(spark, sf_dir, None, (T.CURRENT, T.PRIOR)))


def tmpl_limit_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.doubles(
        M.limit_usage(*_prepared(spark, sf_dir), T.CURRENT), "EXPOSURE_AMT", "LIMIT_AMT", "LIMIT_USAGE_RATE"
    )


def tmpl_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.row_count(_prepared(spark, sf_dir)[0], T.CURRENT)


def tmpl_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unmapped(*_prepared(spark, sf_dir), T.CURRENT)


def tmpl_control_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.doubles(M.control_total(_prepared(spark, sf_dir)[0], T.CURRENT), "EXPOSURE_SUM")


def tmpl_filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.doubles(M.filtered_rows(_prepared(spark, sf_dir)[0], T.CURRENT), "EXPOSURE_AMT")


def tmpl_grouped_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.doubles(M.grouped_exposure(_prepared(spark, sf_dir)[0], T.CURRENT), "EXPOSURE_AMT")


def tmpl_usage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.usage_ratio(*_prepared(spark, sf_dir), T.CURRENT)
    return T.doubles(T.doubles(rows, "EXPOSURE_AMT", "LIMIT_AMT"), "USAGE_RATIO", places=9)


def tmpl_exposure_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.doubles(
        M.exposure_delta(_prepared(spark, sf_dir)[0], T.CURRENT, T.PRIOR),
        "CURRENT_EXPOSURE_AMT", "PRIOR_EXPOSURE_AMT", "EXPOSURE_DELTA",
    )


def tmpl_duplicate_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.duplicate_join_keys(_prepared(spark, sf_dir)[1], T.CURRENT)


_E = f"""WITH {T.EXPOSURES_SQL},{T.LIMITS_SQL},
e AS (SELECT base_dt AS BASE_DT, desk_cd AS DESK_CD, portfolio_id AS PORTFOLIO_ID, risk_factor AS RISK_FACTOR,
  exposure_amt AS EXPOSURE_AMT FROM exposures),
l AS (SELECT base_dt AS BASE_DT, pf_key AS PORTFOLIO_ID, rf_key AS RISK_FACTOR, limit_amt AS LIMIT_AMT,
  use_yn AS USE_YN FROM limits)"""

_TEMPLATES = {
    "tmpl_limit_usage": f"""{_E}, u AS (SELECT BASE_DT, DESK_CD, PORTFOLIO_ID, RISK_FACTOR, sum(EXPOSURE_AMT) AS x
        FROM e WHERE BASE_DT = '19960101' GROUP BY ALL),
      a AS (SELECT * FROM l WHERE BASE_DT = '19960101' AND USE_YN = 'Y')
      SELECT u.BASE_DT, u.DESK_CD, u.PORTFOLIO_ID, u.RISK_FACTOR, CAST(x AS DOUBLE) AS EXPOSURE_AMT,
        CAST(LIMIT_AMT AS DOUBLE) AS LIMIT_AMT,
        CASE WHEN LIMIT_AMT = 0 THEN NULL ELSE round(abs(CAST(x AS DOUBLE)) / CAST(LIMIT_AMT AS DOUBLE) * 100, 2) END AS LIMIT_USAGE_RATE,
        CASE WHEN LIMIT_AMT IS NULL THEN 'NO_LIMIT' WHEN abs(x) > LIMIT_AMT THEN 'BREACH'
          WHEN LIMIT_AMT <> 0 AND abs(x) * 10 >= LIMIT_AMT * 9 THEN 'WARNING' ELSE 'NORMAL' END AS LIMIT_STATUS
      FROM u LEFT JOIN a USING (PORTFOLIO_ID, RISK_FACTOR)""",
    "tmpl_row_count": f"{_E} SELECT BASE_DT, count(*) AS ROW_CNT FROM e WHERE BASE_DT = '19960101' GROUP BY BASE_DT",
    "tmpl_unmapped": f"""{_E} SELECT e.PORTFOLIO_ID, e.RISK_FACTOR, count(*) AS ROW_CNT FROM e LEFT JOIN l
        ON l.BASE_DT = e.BASE_DT AND l.PORTFOLIO_ID = e.PORTFOLIO_ID AND l.RISK_FACTOR = e.RISK_FACTOR AND l.USE_YN = 'Y'
      WHERE e.BASE_DT = '19960101' AND l.PORTFOLIO_ID IS NULL GROUP BY ALL""",
    "tmpl_control_total": f"{_E} SELECT CAST(sum(EXPOSURE_AMT) AS DOUBLE) AS EXPOSURE_SUM FROM e WHERE BASE_DT = '19960101'",
    "tmpl_filtered_rows": f"""{_E} SELECT BASE_DT, PORTFOLIO_ID, RISK_FACTOR, CAST(EXPOSURE_AMT AS DOUBLE) AS EXPOSURE_AMT
      FROM e WHERE BASE_DT = '19960101'""",
    "tmpl_grouped_exposure": f"""{_E} SELECT BASE_DT, PORTFOLIO_ID, RISK_FACTOR, CAST(sum(EXPOSURE_AMT) AS DOUBLE) AS EXPOSURE_AMT
      FROM e WHERE BASE_DT = '19960101' GROUP BY BASE_DT, PORTFOLIO_ID, RISK_FACTOR""",
    "tmpl_usage_ratio": f"""{_E} SELECT e.BASE_DT, e.PORTFOLIO_ID, e.RISK_FACTOR, CAST(e.EXPOSURE_AMT AS DOUBLE) AS EXPOSURE_AMT,
        CAST(l.LIMIT_AMT AS DOUBLE) AS LIMIT_AMT,
        round(abs(CAST(e.EXPOSURE_AMT AS DOUBLE)) / nullif(CAST(l.LIMIT_AMT AS DOUBLE), 0), 9) AS USAGE_RATIO
      FROM e JOIN l USING (BASE_DT, PORTFOLIO_ID, RISK_FACTOR) WHERE e.BASE_DT = '19960101' AND l.USE_YN = 'Y'""",
    "tmpl_exposure_delta": f"""{_E}, sums AS (SELECT BASE_DT, PORTFOLIO_ID, RISK_FACTOR, sum(EXPOSURE_AMT) AS x FROM e GROUP BY ALL)
      SELECT c.PORTFOLIO_ID, c.RISK_FACTOR, CAST(c.x AS DOUBLE) AS CURRENT_EXPOSURE_AMT,
        CAST(p.x AS DOUBLE) AS PRIOR_EXPOSURE_AMT, CAST(c.x - p.x AS DOUBLE) AS EXPOSURE_DELTA
      FROM sums c JOIN sums p ON c.PORTFOLIO_ID = p.PORTFOLIO_ID AND c.RISK_FACTOR = p.RISK_FACTOR
      WHERE c.BASE_DT = '19960101' AND p.BASE_DT = '19951201'""",
    "tmpl_duplicate_join_keys": f"""{_E} SELECT BASE_DT, PORTFOLIO_ID, RISK_FACTOR, count(*) AS ROW_COUNT FROM l
      WHERE BASE_DT = '19960101' GROUP BY ALL HAVING count(*) > 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        status_mix, top_exposures, concentration, heatmap, visual_findings, currency_codes,
        prior_day, prior_day_kpis, prior_day_movers, prior_day_duplicate_keys, prior_day_findings,
        tmpl_limit_usage, tmpl_row_count, tmpl_unmapped, tmpl_control_total, tmpl_filtered_rows,
        tmpl_grouped_exposure, tmpl_usage_ratio, tmpl_exposure_delta, tmpl_duplicate_join_keys,
    )
}
SQL = {
    **{name: f"WITH {T.STATUS_SQL} {sql}" for name, sql in _VISUAL.items()},
    **{name: f"WITH {T.STATUS_SQL}, {_PAIRED} {sql}" for name, sql in _PRIOR.items()},
    **_TEMPLATES,
}
