"""hazeframe: keyed time-series analytics as Spark DataFrame operators.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame operators), ``plans`` (end-to-end chains and the query
catalogue), ``streaming`` (incremental ingestion of landed files).
"""
__version__ = "0.1.0"
