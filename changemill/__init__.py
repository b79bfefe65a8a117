"""changemill: change-data-capture tables as plain Spark jobs.

Change feeds and snapshots go in as DataFrames, exact current-state tables,
schema operations, reconciliation reports and health reports come out.
"""
