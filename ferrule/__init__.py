"""ferrule — seeded test-data generation, data tests and profiling as Spark DataFrame jobs.

Sub-packages:

- ``plans``     dataset specs (tables, columns, keys), type names, build order, manifests
- ``functions`` Column builders: counter-based draws, value generators, text renderers
- ``operators`` DataFrame jobs: generation, data tests, profiling, comparison, discovery
- ``sources``   readers (Parquet, typed JSON lines, declared-schema casts)
- ``sinks``     writers (Parquet, CSV, JSON lines, SQL INSERT, COPY text, catalog namespaces)
- ``streaming`` chunked generation (row-range slices written as successive appends)
"""

from .session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
