"""Training-data operators: one module per operator, `queries` registers them.

Nothing outside this package imports it. Every operator takes DataFrames and column names, reads
whole texts, and runs as Spark jobs; numpy works inside tasks on Arrow batches.
"""
