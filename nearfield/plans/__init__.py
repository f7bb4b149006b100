"""The metadata filter language and its compilation to Spark columns."""
