"""DataFrame-to-DataFrame operators over panels and events."""
