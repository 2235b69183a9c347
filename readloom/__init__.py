"""Sequencing reads and text corpora as Spark DataFrames."""
