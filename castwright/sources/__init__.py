"""File listing, raw CSV tables, the run log and the shared work folder."""
