"""lodestream: Spark-first analytics over key-value logs, vectors, sensor streams and agent memory."""
