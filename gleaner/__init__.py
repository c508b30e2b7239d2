"""gleaner: evidence retrieval and its evaluation as PySpark DataFrame operators."""
