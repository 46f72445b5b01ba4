"""Road-inspection analytics as Spark DataFrame operators."""
