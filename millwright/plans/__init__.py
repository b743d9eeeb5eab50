"""Multi-step jobs, named queries and the metric layer."""
