"""Column expressions: indicators, triggers, costs, statistics, text scores."""
