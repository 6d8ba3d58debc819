"""Operators that prepare scraped market articles as training text. Nothing outside imports this package."""
