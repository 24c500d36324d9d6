"""tarn: a Spark-first engine for knowledge-base and support-ticket text."""
