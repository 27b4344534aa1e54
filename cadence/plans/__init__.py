"""Query plans over the driver tables: panel builders and the query registry."""
