"""corvane: a Spark-first analytics engine for multilingual text corpora."""
