"""Run plans: configuration, the stacked battery, and the registered queries by subject."""
