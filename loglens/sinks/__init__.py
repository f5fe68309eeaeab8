"""Where results go: lines, events, metrics, and the wire formats they travel in."""
