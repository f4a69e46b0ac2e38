"""Spark-native data quality and profiling.

Sub-packages
------------
``functions``  column helpers and distributed ordering helpers
``operators``  DataFrame -> DataFrame operators, one module per subject
``sources``    readers and writers
``plans``      operators chained into whole runs
``streaming``  the same rules on Structured Streaming
"""
