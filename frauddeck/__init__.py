"""frauddeck: payments-fraud analytics and feature building as Spark DataFrame operators.

Sub-packages
------------
sources    typed readers, writers, stage checkpoints, the driver-table adapter
functions  pure ``Column -> Column`` helpers (cleaning rules, calendar, geometry, flags)
operators  ``DataFrame -> DataFrame`` operators: dedup, star joins, windows, profiles,
           encoders, splits, global ranks, metrics, blends, Spark ML jobs
plans      composite pipelines and the registered query catalogue
streaming  (empty by design: the reference has no streaming operators)
"""

__version__ = "0.1.0"
