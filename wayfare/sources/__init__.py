"""Sources: GA4-style event readers and CRM/curated table builders."""
