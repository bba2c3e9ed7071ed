"""Query registry over the driver tables: adapters, Spark plans and their SQL twins."""
