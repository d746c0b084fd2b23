"""Sources: input lines, toll history, line streams, and roads projected from `events`."""
