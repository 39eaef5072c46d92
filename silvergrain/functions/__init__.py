"""Pure Column -> Column helpers (text, time, geography, scoring arithmetic)."""
