"""A semantic-model query engine on PySpark."""
