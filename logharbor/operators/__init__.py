"""DataFrame operators over the log, cluster, incident and alert tables."""
