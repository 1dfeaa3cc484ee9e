"""marlstone: a Spark-first engine for searching, curating and evaluating a tagged catalogue."""
