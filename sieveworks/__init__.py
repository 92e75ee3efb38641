"""sieveworks: a Spark-first analysis engine for corpora of source files and documents."""
