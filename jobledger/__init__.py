"""jobledger: set-wise data rules for a job-application service, on Spark.

Every rule is a ``Column -> Column`` or ``DataFrame -> DataFrame`` function so
Catalyst can prune, push down and code-generate it; batch and Structured
Streaming forms share the same functions.
"""

__version__ = "0.1.0"
