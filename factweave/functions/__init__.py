"""Column expressions without actions: dates, statistics, number formats."""
