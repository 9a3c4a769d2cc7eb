"""Execution traces and resource measurements of embedded systems, analysed at fleet scale on Spark."""
