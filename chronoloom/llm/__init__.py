"""Operators of a training-data pipeline on Spark. Nothing outside this folder imports it."""
