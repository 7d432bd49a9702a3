"""Column helpers and skew-safe rank / median building blocks."""
