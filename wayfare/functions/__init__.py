"""Pure ``Column`` builders; no DataFrame is touched here."""
