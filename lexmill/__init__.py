"""lexmill: lexical normalisation analytics as Spark DataFrame programs."""
