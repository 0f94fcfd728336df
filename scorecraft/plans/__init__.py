"""Query plans registered for the driver, test fixtures derived from the
driver tables, and the independent DuckDB SQL each plan is checked against."""
