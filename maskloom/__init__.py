"""maskloom: find, replace, remember and reverse sensitive values in Spark tables."""
