"""Column functions: text hygiene, casing, spelling rules, transliteration."""
