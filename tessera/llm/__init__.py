"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; what an operator has to read more than once is written as Parquet to
the folder in ``spark.checkpoint.dir`` (see :mod:`tessera.llm.common`).
"""
