"""End-to-end plans: writing split tables, loading them into the Spark catalog, audit logging."""
