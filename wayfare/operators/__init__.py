"""The analyses, each a function DataFrame(s) -> DataFrame."""
