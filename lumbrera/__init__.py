"""Text-accessibility auditing and usage analytics as Spark DataFrame transformations."""
