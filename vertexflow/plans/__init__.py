"""The superstep loop and SQL text for checking it."""
