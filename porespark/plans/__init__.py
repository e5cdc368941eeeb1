"""Plan-level building blocks and end-to-end pipelines."""
