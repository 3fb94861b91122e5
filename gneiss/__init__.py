"""Evidence-corpus analytics as PySpark DataFrame operators."""
