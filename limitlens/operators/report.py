"""Report sections of a finished analysis as tables, written partitioned by base date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from limitlens import schema as S
from limitlens.operators import limits as L, reconcile as R, visual as V
from limitlens.plans.reuse import materialized
from limitlens.plans.local import local_table


@dataclass(frozen=True)
class LimitAnalysis:
    """Everything one run over the requested base dates yields."""

    inputs: L.LimitInputs
    status: DataFrame
    kpis: DataFrame
    exceptions: DataFrame
    summary: DataFrame
    result: DataFrame
    audit: DataFrame
    findings: DataFrame


def analyze(inputs: L.LimitInputs, materialize: bool = True) -> LimitAnalysis:
    """All parts of the limit analysis.

    The status table feeds most of them; ``materialize`` writes it once to the checkpoint
    folder, so the join with the limits runs once.
    """
    status = L.limit_status(inputs)
    if materialize:
        status = materialized(status)
    kpis = L.limit_kpis(status)
    exceptions = R.recon_exceptions(inputs, status)
    if materialize:
        exceptions = materialized(exceptions)
    summary = R.recon_summary(inputs, exceptions)
    result = R.recon_result(summary)
    findings = L.limit_findings(inputs, kpis).unionByName(_recon_finding(result))
    return LimitAnalysis(
        inputs, status, kpis, exceptions, summary, result, R.join_audit(inputs, status), findings
    )


def _recon_finding(result: DataFrame) -> DataFrame:
    passed = F.col("state") == "PASS"
    text = F.concat(
        F.col("state"), F.lit(", checks="), F.col("check_count").cast("string"),
        F.lit(", exceptions="), F.col("recon_exceptions").cast("string"),
    )
    good = S.finding("RECON_SUMMARY", "Info", text)
    bad = S.finding("RECON_SUMMARY", "High", text)
    return result.select("base_dt", F.when(passed, good).otherwise(bad).alias("f")).select("base_dt", "f.*")


def exception_list(exceptions: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Exceptions of the analysis, and validation findings of severity High or above."""
    shape = ("type", "severity", "code", "message", "base_dt", "portfolio_id", "risk_factor", "n")
    rows = exceptions.withColumn("type", F.lit("Analysis")).select(*shape)
    if findings is None:
        return rows
    severe = findings.filter(F.col("severity_rank") >= S.SEVERITY_RANK["High"])
    return rows.unionByName(severe.select(
        F.lit("Validation").alias("type"), "severity", "code", "message",
        F.lit("").alias("base_dt"), F.lit("").alias("portfolio_id"), F.lit("").alias("risk_factor"),
        F.lit(1).cast("long").alias("n"),
    ))


def exception_count(exceptions: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    return exception_list(exceptions, findings).agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("exception_count")
    )


def risk_visual(status: DataFrame, n: int = V.DEFAULT_TOP_N) -> DataFrame:
    """Chart aggregates in long form: section, base date, name, metric, value."""
    def long(df: DataFrame, section: str, name: str, metrics: list[str]) -> DataFrame:
        values = F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in metrics
        ])
        return df.select(
            F.lit(section).alias("section"), "base_dt", F.col(name).cast("string").alias("name"),
            F.explode(values).alias("v"),
        ).select("section", "base_dt", "name", "v.*")

    totals = V.concentration(status, n).withColumn("all", F.lit("ALL"))
    heat = V.heatmap(status).withColumn("cell", F.concat_ws("/", "portfolio_id", "risk_factor"))
    return (
        long(V.status_mix(status), "STATUS_DISTRIBUTION", "status", ["row_count", "ratio"])
        .unionByName(long(V.top_exposures(status, n), "TOP_EXPOSURE", "rank", [
            "portfolio_id", "risk_factor", "ccy_cd", "exposure_amt", "abs_exposure", "usage_ratio", "status"]))
        .unionByName(long(totals, "CONCENTRATION", "all", [
            "total_abs_exposure", "top_abs_exposure", "top_share", "hhi", "row_count", "top_count"]))
        .unionByName(long(heat, "HEATMAP", "cell", ["usage_ratio", "grade", "status"]))
    )


def report_tables(
    analysis: LimitAnalysis, profile_rows: DataFrame | None = None, validation: DataFrame | None = None,
    source_name: str = "",
) -> dict[str, DataFrame]:
    """The data sections of the report. ``profile_rows`` comes from ``profile.profile_table``."""
    spark = analysis.inputs.spark
    states = analysis.result.select("base_dt", "check_count", F.col("state").alias("reconciliation"))
    counts = analysis.exceptions.groupBy("base_dt").agg(F.sum("n").alias("exception_count"))
    sections = {
        "SUMMARY": analysis.kpis.join(states, "base_dt", "full").join(counts, "base_dt", "left"),
        "LIMIT_MONITORING": analysis.status.select(*S.STATUS_COLUMNS),
        "EXCEPTION_LIST": exception_list(analysis.exceptions, validation),
        "RECONCILIATION": analysis.summary,
        "RISK_VISUAL": risk_visual(analysis.status),
        "VALIDATION": validation if validation is not None else local_table(
            spark, [("Info", "VALIDATION_OK", "no findings", None)],
            "severity string, code string, message string, position int",
        ),
    }
    if profile_rows is not None:
        sections["DATA_PROFILE"] = profile_rows
        sections["RAW_DATA"] = profile_rows.filter(F.col("section") == "Table").select(
            F.lit(source_name).alias("source_name"), "metric", "value"
        )
    return sections


def write_report(sections: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One Parquet table per section; those with a base date are partitioned by it.

    Overwriting replaces the dates that are written and keeps the others. Rows are
    rebalanced by date first, so a date is a few files, not one from every task.
    """
    for name, df in sections.items():
        writer = df.write.mode(mode)
        if "base_dt" in df.columns:
            rows = df.hint("rebalance", "base_dt")
            writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("base_dt")
        writer.parquet(f"{path}/{name.lower()}")
