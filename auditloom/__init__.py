"""Code-audit analytics as Spark plans: fact tables, detectors, a findings pipeline, correlation and reports."""
