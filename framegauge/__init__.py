"""Frame-sequence gating, evidence auditing and telemetry as Spark jobs."""
