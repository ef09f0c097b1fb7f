"""Column functions: text, amounts, dates, fuzzy matching and fixed word lists."""
