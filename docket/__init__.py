"""docket: a PySpark engine for versioned corpora of long, semi-structured texts."""
