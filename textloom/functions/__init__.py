"""Column expressions: text cleaning, names, hashes and schedules."""
