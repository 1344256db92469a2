"""Analytics over append-only, verifiable logs, as DataFrame functions."""
