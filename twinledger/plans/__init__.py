"""Plan-level helpers: sessions, reliable checkpoints, the registered queries."""
