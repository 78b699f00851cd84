"""tracequill: a PySpark-native engine for evidence-traceable document analytics.

``operators`` holds DataFrame operators, ``functions`` column expressions,
``sources`` readers and sinks, ``plans`` the registered queries with their
DuckDB counterparts, and ``streaming`` the incremental forms.
"""
