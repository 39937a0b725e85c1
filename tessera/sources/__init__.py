"""Part of tessera: sources."""
