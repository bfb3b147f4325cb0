"""Operators for preparing language-model training data at corpus scale.

Nothing outside this package imports it; it needs Spark, pyarrow, numpy, pandas, xxhash and tiktoken.
"""
