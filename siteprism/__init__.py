"""Site-audit analytics as Spark DataFrame plans, for all sites at once."""
