"""Sources of hits, payloads, verdicts, logs and images."""
