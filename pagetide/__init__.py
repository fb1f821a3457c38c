"""pagetide: web-page change analytics on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``sources`` (readers,
sinks, proxy views), ``operators`` (DataFrame -> DataFrame steps),
``plans`` (named queries and their SQL oracles), ``streaming``.
"""
