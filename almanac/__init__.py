"""A Spark engine for rolling release catalogues."""
