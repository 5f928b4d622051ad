"""Row-local audits over unbounded inputs."""
