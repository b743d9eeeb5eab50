"""Reading, writing and changing stored tables."""
