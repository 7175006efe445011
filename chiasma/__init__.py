"""Chiasma: crossover and genomic-interval analytics on PySpark DataFrames."""
