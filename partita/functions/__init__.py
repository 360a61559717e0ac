"""Part of partita."""
