"""One normaliser per feed: from the feed's own schema to tracks, features and events."""
