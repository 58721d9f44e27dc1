"""Scalar and aggregate functions of the pipe language as Spark columns."""
