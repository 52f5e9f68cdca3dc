"""shapecast: query-history analytics on Spark.

Reads a query log in the account-usage layout, extracts each statement's shape
with column expressions, divides drift out of measured runtimes, builds
pre-run features with a prior from earlier batches only, trains and gates
runtime models with Spark ML, and publishes prediction, SLA and check tables;
plus the star-query family such a log records.
"""

__version__ = "0.1.0"
