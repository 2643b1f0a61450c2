"""DataFrame-to-DataFrame operators over all segments at once."""
