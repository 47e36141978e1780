"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written from the operator definitions, not generated from the Spark
code: nothing here imports ``lodestar``.
"""
