"""A PySpark engine that cleans, audits and prepares scraped long-form text."""
