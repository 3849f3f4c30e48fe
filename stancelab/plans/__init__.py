"""End-to-end plans: the driver-table query registry, SQL oracles and study pipelines."""
