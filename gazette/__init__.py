"""Gazette: a rolling news corpus built, indexed and queried with Spark DataFrames."""
