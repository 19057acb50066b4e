"""limitlens: daily risk-limit control as Spark DataFrame jobs."""

__version__ = "0.1.0"
