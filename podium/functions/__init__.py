"""Column functions: text, identifiers, dates, durations and scoring."""
