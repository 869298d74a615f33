"""quern: a PySpark engine for content-addressed, schema-governed document graphs."""
