"""Solvers of single series in numpy, without Spark."""
