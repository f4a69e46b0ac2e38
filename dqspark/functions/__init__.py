"""Column helpers (``scalars``) and distributed ordering (``ordering``)."""
