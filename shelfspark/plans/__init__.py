"""Query catalogue with its SQL counterparts."""
